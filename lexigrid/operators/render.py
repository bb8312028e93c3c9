"""Sentences as text: spacing, and marked words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.dictionary import SOURCE_FIELDS

NO_SPACE_AFTER = ["(", "[", "{", "«", "`"]
NO_SPACE_BEFORE = [".", "!", "?", ",", ":", ";", ")", "]", "}", "%", "»", "`"]


def spaced(tokens: DataFrame) -> DataFrame:
    """With ``space``: '' or ' ' before each token, by its first character; double quotes open and close in turn. tokens: sentence, pos, word_case."""
    order = Window.partitionBy("sentence").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.substring("word_case", 1, 1)
    quote = first == '"'
    rows = tokens.withColumn("__n", F.sum(quote.cast("int")).over(so_far)).withColumn("__open", quote & (F.col("__n") % 2 == 1))
    rows = rows.withColumn("__after", first.isin(*NO_SPACE_AFTER) | F.col("__open"))
    before = first.isin(*NO_SPACE_BEFORE) | (quote & ~F.col("__open"))
    tight = before | F.coalesce(F.lag("__after").over(order), F.lit(False))
    return rows.withColumn("space", F.when(tight, "").otherwise(" ")).drop("__n", "__open", "__after")


def marked(hit: Column | None = None, of: Callable[[str], Column] = F.col) -> Column:
    """A token in a span; ``hit``: its slot from 0, null if it has none; ``of`` gives its fields."""
    title = F.concat(F.lit(" title='("), of("lemma"), F.lit(") "), of("tags"), F.lit("'>"), of("word_case"))
    plain = F.concat(F.lit("<span class='regular_word'"), title, F.lit("</span><!-- regular_word -->"))
    if hit is None:
        return plain
    number = hit.cast("string")
    found = F.concat(F.lit("<span class='found_word' id='found_word_"), number, F.lit("'"), title, F.lit("</span><!-- found_word_"), number, F.lit(" -->"))
    return F.when(hit.isNotNull(), found).otherwise(plain)


def assemble(tokens: DataFrame, shown: Column, keys: list[str], name: str = "sentence_text") -> DataFrame:
    """One row for each of ``keys``: its tokens in order."""
    parts = tokens.select(*keys, F.struct("pos", F.concat("space", shown).alias("t")).alias("__t")).groupBy(*keys).agg(F.array_sort(F.collect_list("__t")).alias("__ts"))
    return parts.select(*keys, F.concat_ws("", F.col("__ts.t")).alias(name))


def plain_sentences(tokens: DataFrame) -> DataFrame:
    return assemble(spaced(tokens), F.col("word_case"), ["sentence"])


def hit_sentences(tokens: DataFrame, page: DataFrame) -> DataFrame:
    """z1, sentence and its marked text for each row of a page, which has 1,000 rows at most and is broadcast; only the page's sentences are moved."""
    zs = [c for c in page.columns if c.startswith("z")]
    wanted = page.select(F.col("sentence").alias("__s"), F.col("z1").alias("anchor"), F.array(*zs).alias("__zs"))
    own = spaced(tokens.join(F.broadcast(wanted.select(F.col("__s").alias("sentence"))), "sentence", "left_semi"))
    rows = own.join(F.broadcast(wanted), F.col("sentence") == F.col("__s"))
    at = F.array_position("__zs", F.col("id"))
    return assemble(rows, marked(F.when(at > 0, at - 1)), ["anchor", "sentence", "source"]).withColumnRenamed("anchor", "z1")


def context(tokens: DataFrame, around: int, reach: int) -> DataFrame:
    """Sentences around - reach to around + reach, across sources, without marks of hits."""
    own = tokens.where(F.col("sentence").between(around - reach, around + reach))
    return assemble(spaced(own), marked(), ["sentence", "source"])


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The metadata of each row's source."""
    meta = sources.select(F.col("id").alias("__id"), *[F.coalesce(F.col(c), F.lit("")).alias(f"s_{c}") for c in SOURCE_FIELDS])
    return rows.join(meta, F.col("source") == F.col("__id")).drop("__id")


def row_struct() -> Column:
    s = lambda c: F.col(f"s_{c}")
    return F.struct(F.col("sentence").alias("id"), s("nice").alias("nice"), s("author").alias("author"), F.col("source").alias("title_id"), *[s(c).alias(c) for c in SOURCE_FIELDS[2:]], F.col("sentence_text").alias("sentence"))
