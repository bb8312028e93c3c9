"""Tagged text: one sentence a line, units as ``^surface/lemma<t>...[+sub<t>...][/next reading]$``, other text between units.

A backslash before a character of the format makes it plain; a lemma that begins with ``*`` is an unknown word. (The format's public description
says so; the corpus at hand doesn't show either.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions.tokens import sort_tags
from lexigrid.operators.lines import let
from lexigrid.sources.shared import stored

UNIT = r"\^((?:[^\\^$]|\\.)*)\$"
#: Sentences of a block, as a power of two.
BLOCK_BITS = 16
PIECE = r"([^\^]*)\^((?:[^\\^$]|\\.)*)\$"


def stripped(line: Column) -> Column:
    """Without a byte-order mark, and blanks at the ends."""
    return F.regexp_replace(F.regexp_replace(line, "^﻿", ""), "^[ \r\n]+|[ \r\n]+$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """sentence (the line's number from 0, over the files by path) and line, stripped; a byte-order mark goes. bz2 files are split by Spark."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    # lines of one piece of a file are read one after another, whatever task has the piece
    rows = stored(text.withColumn("__at", F.monotonically_increasing_id()), "lines")
    pieces = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__least"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row a piece
    pieces = pieces.select(F.col("__file").alias("__f"), F.col("__block").alias("__b"), "__least", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    out = rows.join(F.broadcast(pieces), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return out.select((F.col("__start") + F.col("__at") - F.col("__least")).alias("sentence"), stripped(F.col("value")).alias("line"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """sentence, source from a tab-separated map; sentences must be dense from 0."""
    out = spark.read.schema("sentence bigint, source bigint").csv(path, sep="\t")
    r = out.agg(F.count("*").alias("n"), F.min("sentence").alias("lo"), F.max("sentence").alias("hi"), F.count_distinct("sentence").alias("d")).first()
    if r["n"] and not (r["lo"] == 0 and r["hi"] == r["n"] - 1 == r["d"] - 1):
        raise ValueError("sentence ids in the map aren't dense from 0")
    return out


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def _under(c: Column) -> Column:
    return F.translate(c, " ", "_")


def _blank(piece: Column) -> Column:
    """The text before a piece's unit."""
    return F.regexp_replace(F.regexp_extract(piece, PIECE, 1), "^[ \t]+|[ \t]+$", "")


def _size(line: Column) -> Column:
    """How many tokens tokens_of() gives."""
    return let(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda pieces: F.size(pieces) + F.size(F.filter(pieces, lambda p: _blank(p) != "")))


def tokens_of(line: Column) -> Column:
    """An array of word_case, word, lemma, tags of the line's units and of the text between them; text after the last unit is lost.

    The lemma is the first part of the last reading; tags are those of all parts of all readings."""
    base = lambda s: _plain(F.regexp_extract(s, r"^((?:[^\\<]|\\.)*)", 1))
    tag_list = lambda s: F.array_join(F.regexp_extract_all(s, F.lit(r"<[^>]*>"), F.lit(0)), ",")

    def unit(parts: Column, subs: Column) -> Column:
        joined = F.array_join(F.transform(F.flatten(subs), lambda s, i: F.when(i == 0, tag_list(s)).otherwise(F.concat(F.lit("+"), base(s), tag_list(s)))), ",")
        # the mark of an unknown word is a plain star
        last = F.regexp_replace(F.try_element_at(F.try_element_at(subs, F.lit(-1)), F.lit(1)), r"^\*", "")
        lemma = F.coalesce(F.lower(base(last)), F.lit(""))

        def made(s: Column, lemma: Column, joined: Column) -> Column:
            none = (F.lower(s) == "") & (lemma == "")
            own = F.when(joined.isin("", "<>"), "*").otherwise(joined)
            return F.struct(_under(s).alias("word_case"), F.when(none, "/").otherwise(_under(F.lower(s))).alias("word"), F.when(none, "/").otherwise(_under(lemma)).alias("lemma"), sort_tags(F.coalesce(own, F.lit("*"))).alias("tags"))

        return let(_plain(parts[0]), lambda s: let(lemma, lambda m: let(joined, lambda j: made(s, m, j))))

    def tokens(piece: Column) -> Column:
        gap = lambda blank: F.struct(blank.alias("word_case"), blank.alias("word"), blank.alias("lemma"), F.lit("<sym>").alias("tags"))
        readings = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda r: F.split(r, r"(?<!\\)\+"))
        own = let(F.split(F.regexp_extract(piece, PIECE, 2), r"(?<!\\)/"), lambda parts: let(readings(parts), lambda subs: unit(parts, subs)))
        return let(_blank(piece), lambda blank: let(own, lambda u: F.when(blank != "", F.array(gap(blank), u)).otherwise(F.array(u))))

    return F.flatten(F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), tokens))


def parse(rows: DataFrame) -> DataFrame:
    """sentence, pos, word_case, word, lemma, tags of the tokens of each line, as by tokens_of()."""
    # the outer form, as for the plain one Spark adds a filter that makes the tokens twice
    out = rows.select("sentence", F.posexplode_outer(tokens_of(F.col("line"))).alias("pos", "x")).where("pos IS NOT NULL")
    return out.select("sentence", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"x.{c}").alias(c) for c in ("word_case", "word", "lemma", "tags")])


def placed(rows: DataFrame, sentence_sources: DataFrame) -> DataFrame:
    """parse() and with_ids() of lines in one: lines are counted and numbered, not tokens, and these are made once, where they are returned."""
    counts = rows.select("sentence", _size(F.col("line")).cast("bigint").alias("__n")).withColumn("__b", F.shiftright("sentence", BLOCK_BITS))
    inside = Window.partitionBy("__b").orderBy("sentence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row a block
    sums = counts.groupBy("__b").agg(F.sum("__n").alias("__m"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(F.col("__b").alias("__c"), (F.sum("__m").over(before) - F.col("__m")).alias("__start"))
    firsts = counts.select("sentence", "__b", (F.sum("__n").over(inside) - F.col("__n")).alias("__at")).join(F.broadcast(sums), F.col("__b") == F.col("__c"))
    firsts = firsts.select("sentence", (F.col("__start") + F.col("__at")).alias("__first"))
    out = rows.join(sentence_sources, "sentence").join(firsts, "sentence")
    out = out.select("sentence", "source", "__first", F.posexplode_outer(tokens_of(F.col("line"))).alias("pos", "x")).where("pos IS NOT NULL")
    return out.select((F.col("__first") + F.col("pos")).alias("id"), "sentence", F.col("pos").cast("bigint").alias("pos"), "source", *[F.col(f"x.{c}").alias(c) for c in ("word_case", "word", "lemma", "tags")])


def with_ids(tokens: DataFrame, sentence_sources: DataFrame) -> DataFrame:
    """With source and the corpus position."""
    from lexigrid.operators.numbering import numbered

    rows = tokens.join(sentence_sources, "sentence")
    return numbered(rows, "id", [F.col("sentence"), F.col("pos")]).select("id", "sentence", "pos", "source", "word_case", "word", "lemma", "tags")
