"""The star schema: lexicons, token types, the fact table, sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.numbering import numbered

SOURCE_FIELDS = ("nice", "author", "title", "date", "type", "genre", "source", "url", "meta", "full")


def _freq(rows: DataFrame) -> Column:
    """How many tokens a group of rows stands for: rows are tokens, or token types with their freq."""
    return F.sum("freq") if "freq" in rows.columns else F.count("*")


def lexicon(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """id (rank in code-point order), freq, and the distinct value, of tokens or of token types (far fewer rows)."""
    counted = rows.groupBy(column).agg(_freq(rows).alias("freq"))
    out = numbered(counted, "id", [F.col(column)])
    return out.select("id", "freq", F.col(column).alias(name or column))


def unique_tags(rows: DataFrame) -> DataFrame:
    """Single tags, repeats in a tag set counted, without those that have a star; id by descending frequency, then tag."""
    counted = rows.groupBy("tags").agg(_freq(rows).alias("n")).select(F.explode(F.split("tags", ",")).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("freq"))
    kept = counted.where(~F.col("tag").contains("*"))
    # a tag inventory: some hundreds of rows
    return kept.select((F.row_number().over(Window.orderBy(F.desc("freq"), "tag")) - 1).cast("bigint").alias("id"), "freq", "tag")


def longest(tokens: DataFrame, column: str = "word_case") -> DataFrame:
    """The length in characters of the longest value, and of those the first in code-point order."""
    lengths = tokens.select(F.length(column).cast("bigint").alias("n"), F.col(column).alias("v"))
    return lengths.groupBy("n").agg(F.min("v").alias("v")).agg(F.max("n").alias("length"), F.max_by("v", "n").alias(column))


@dataclass
class Star:
    words_case: DataFrame
    words: DataFrame
    lemmas: DataFrame
    tags: DataFrame
    tags_uniq: DataFrame
    united: DataFrame
    types: DataFrame
    main: DataFrame
    sources: DataFrame


def types_of(tokens: DataFrame) -> DataFrame:
    """Distinct (word_case, word, lemma, tags) with their frequency, and their id: as lexicon ids are ranks of the strings, the rank of
    the four ids is the rank of the four strings."""
    counted = tokens.groupBy("word_case", "word", "lemma", "tags").agg(F.count("*").alias("freq"))
    return numbered(counted, "id", [F.col(c) for c in ("word_case", "word", "lemma", "tags")])


def united_of(types: DataFrame, words_case: DataFrame, words: DataFrame, lemmas: DataFrame, tags: DataFrame) -> DataFrame:
    out = types
    for lex, column in ((words_case, "word_case"), (words, "word"), (lemmas, "lemma")):
        out = out.join(lex.select(F.col(column), F.col("id").alias(f"{column}_id")), column)
    out = out.join(tags.select(F.col("combinations").alias("tags"), F.col("id").alias("tags_id")), "tags")
    return out.select("id", "freq", *[F.col(f"{c}_id").alias(c) for c in ("word_case", "word", "lemma", "tags")])


def main_of(tokens: DataFrame, types: DataFrame) -> DataFrame:
    """id (corpus position), united, sentence, source, pos. tokens already carry id and dense sentence numbers."""
    key = ["word_case", "word", "lemma", "tags"]
    return tokens.join(types.select(*key, F.col("id").alias("united")), key).select("id", "united", "sentence", "source", "pos")


def build(tokens: DataFrame, sources: DataFrame, types: DataFrame | None = None) -> Star:
    types = types_of(tokens) if types is None else types
    lex = {c: lexicon(types, c) for c in ("word_case", "word", "lemma")}
    tags = lexicon(types, "tags", "combinations")
    united = united_of(types, lex["word_case"], lex["word"], lex["lemma"], tags)
    return Star(lex["word_case"], lex["word"], lex["lemma"], tags, unique_tags(types), united, types, main_of(tokens, types), sources)
