"""N-gram tables of one to six token types, and their search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.numbering import numbered
from lexigrid.operators.predicates import slot_column
from lexigrid.plans.query import CorpusQuery

LEVELS = 6
GRAMS = [f"g{i + 1}" for i in range(LEVELS)]


def counts(rows: DataFrame, levels: int = LEVELS, first_between: tuple[int, int] | None = None) -> DataFrame:
    """level, g1..g6, freq of all runs within a segment. rows: sentence, pos, united, and segment if there are any.

    One rollup over all levels; a row without a k-th token doesn't count at level k. ``first_between`` keeps a range of first ids."""
    keys = ["sentence", *(["segment"] if "segment" in rows.columns else [])]
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = rows.select(F.col("united").alias("g1"), *[F.lead("united", i).over(w).alias(f"g{i + 1}") for i in range(1, levels)])
    if first_between:
        ahead = ahead.where(F.col("g1").between(*first_between))
    # a full-depth count first: what the rollup multiplies by the number of levels is then the distinct rows alone
    full = ahead.groupBy(*GRAMS[:levels]).agg(F.count("*").alias("n"))
    rolled = full.rollup(*GRAMS[:levels]).agg(F.sum("n").alias("freq"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, levels)
    for k in range(1, levels):
        level = level.when(F.col("gid") == (1 << (levels - k)) - 1, k)
    out = rolled.withColumn("level", level).where("level IS NOT NULL")
    own = F.when(F.col("level") == 1, F.col("g1"))
    for k in range(2, levels + 1):
        own = own.when(F.col("level") == k, F.col(f"g{k}"))
    out = out.where(own.isNotNull())
    blank = [F.lit(None).cast("bigint").alias(g) for g in GRAMS[levels:]]
    return out.select(F.col("level").cast("bigint").alias("level"), *GRAMS[:levels], *blank, "freq")


def ranked(grams: DataFrame) -> DataFrame:
    """With node: from 0 at each level, by descending frequency, then ids."""
    return numbered(grams, "node", [F.desc("freq"), *[F.col(g) for g in GRAMS]], within="level")


def trie(nodes: DataFrame) -> DataFrame:
    """level, node, parentnode, united, freq: the same table with links. Level 1 has no parent."""
    out = None
    for k in range(1, LEVELS + 1):
        own = nodes.where(F.col("level") == k).select("level", "node", F.col(f"g{k}").alias("united"), "freq", *[F.col(g).alias(f"o{g}") for g in GRAMS[: k - 1]])
        if k == 1:
            part = own.withColumn("parentnode", F.lit(None).cast("bigint"))
        else:
            above = nodes.where(F.col("level") == k - 1).select(*GRAMS[: k - 1], F.col("node").alias("parentnode"))
            part = own.join(above, [F.col(f"o{g}") == F.col(g) for g in GRAMS[: k - 1]])
        part = part.select("level", "node", "parentnode", "united", "freq")
        out = part if out is None else out.unionByName(part)
    return out


def search(nodes: DataFrame, types: DataFrame, query: CorpusQuery, compat: bool = False) -> DataFrame:
    """All n-grams whose words match the filled slots before the first gap. Regular expressions match any part of a word.

    ``compat`` leaves out n-grams that pass through the most frequent node of a level above."""
    slots = query.prefix
    if not slots:
        raise ValueError("an n-gram search needs a condition in the first slot")
    k = len(slots)
    out = nodes.where(F.col("level") == k)
    for i, slot in enumerate(slots):
        ids = types.where(slot_column(slot, query.regex, anchor=False)).select(F.col("id").alias(GRAMS[i]))
        out = out.join(ids, GRAMS[i], "left_semi")
    if compat:
        for j in range(1, k):
            top = nodes.where((F.col("level") == j) & (F.col("node") == 0)).select(*GRAMS[:j])
            out = out.join(top, GRAMS[:j], "left_anti")
    return out.select("level", "node", *GRAMS, "freq")


def top(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("freq"), "node").limit(n)


def with_words(found: DataFrame, types: DataFrame, level: int, column: str = "word_case") -> DataFrame:
    """node, freq, and the words in text order, for the rows of one level."""
    out = found
    for g in GRAMS[:level]:
        out = out.join(types.select(F.col("id").alias(f"__{g}"), F.col(column).alias(f"w{g}")), F.col(g) == F.col(f"__{g}")).drop(f"__{g}")
    return out.select("node", "freq", F.array(*[f"w{g}" for g in GRAMS[:level]]).alias("ngram"))
