"""Token types' ids for the tokens of sentences: a block's distinct forms are looked up, and its tokens are coded from these."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.lines import FIELDS, Lines, exploded

#: Ids are 32-bit within n-gram windows.
MOST_TYPES = (1 << 31) - 2


def coded(lines: Lines, types: DataFrame, attribute, words: bool = False) -> DataFrame:
    """sentence, first, source, ids (an array with the type of each token) and, with ``words``, lang and the words, of lines of plain text.

    Words have no white space, so a line is its words with blanks between; what is moved is the text, and each block's distinct forms."""
    text = F.array_join(lines.words, " ").alias("text")
    own = lines.rows.select("block", "sentence", "first", "source", "lang", text)
    forms = exploded(lines.stored, ["block", "lang"], lines.words, "__p", "form").select("block", "lang", "form").distinct()
    key = [F.col(f"__{f}") == F.col(f) for f in FIELDS]
    named = forms.select(F.col("block").alias("__k"), F.col("lang").alias("__l"), "form", *[_field(attribute, f).alias(f"__{f}") for f in FIELDS])
    found = named.join(types.select("id", *FIELDS), key).select("__k", F.col("__l").alias("lang"), "form", F.col("id").cast("int").alias("id"))

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(left["lang"]).to_pylist():
            rows = left.filter(pc.equal(left["lang"], lang)).combine_chunks()
            known = right.filter(pc.equal(right["lang"], lang)).combine_chunks()
            cut = pc.split_pattern(rows["text"], " ").combine_chunks()
            ids = pc.take(known["id"].combine_chunks(), pc.index_in(cut.flatten(), value_set=known["form"].combine_chunks()))
            listed = pa.ListArray.from_arrays(cut.offsets, ids)
            kept = [rows[c] for c in ("sentence", "first", "source")]
            out.append(pa.table([*kept, listed, *([rows["lang"], rows["text"]] if words else [])], names=["sentence", "first", "source", "ids", *(["lang", "text"] if words else [])]))
        return pa.concat_tables(out).combine_chunks()

    schema = "sentence bigint, first bigint, source bigint, ids array<int>" + (", lang string, text string" if words else "")
    return own.groupBy("block").cogroup(found.groupBy("__k")).applyInArrow(code, schema)


def _field(attribute, name: str) -> Column:
    return attribute(F.col("form"), name)


def of_main(main: DataFrame) -> DataFrame:
    """The same of a fact table."""
    rows = main.groupBy("sentence").agg(F.min("id").alias("first"), F.min("source").alias("source"), F.array_sort(F.collect_list(F.struct("pos", F.col("united").cast("int").alias("u")))).alias("us"))
    return rows.select("sentence", "first", "source", F.col("us.u").alias("ids"))


def main_of(found: DataFrame) -> DataFrame:
    """id, united, sentence, source, pos of the tokens."""
    out = exploded(found, ["sentence", "first", "source"], F.col("ids"), "__p", "united")
    return out.select((F.col("first") + F.col("__p")).alias("id"), F.col("united").cast("bigint").alias("united"), "sentence", "source", F.col("__p").cast("bigint").alias("pos"))


def dump_of(found: DataFrame, attribute) -> DataFrame:
    """main_of() with the strings, of what coded() gives with words."""
    both = F.arrays_zip(F.col("ids").alias("id"), F.split("text", " ").alias("form"))
    out = exploded(found.select("sentence", "first", "source", "lang", both.alias("both")), ["sentence", "first", "source", "lang"], F.col("both"), "__p", "x")
    out = out.select((F.col("first") + F.col("__p")).alias("id"), F.col("x")["id"].cast("bigint").alias("united"), "sentence", "source", "lang", F.col("x")["form"].alias("form"))
    return out.select("id", "united", "sentence", "source", *[_field(attribute, f).alias(f) for f in FIELDS])
