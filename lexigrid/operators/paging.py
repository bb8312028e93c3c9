"""Pages of matches: one row for each first token, keyset cursor, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchors(found: DataFrame) -> DataFrame:
    """z1, sentence, source, the first tuple of each z1 in lexicographic order, and n_tuples."""
    rest = [c for c in found.columns if c.startswith("z") and c != "z1"]
    first = [F.min(F.struct(*rest)).alias("__first")] if rest else []
    out = found.groupBy("z1").agg(F.min("sentence").alias("sentence"), F.min("source").alias("source"), *first, F.count("*").alias("n_tuples"))
    return out.select("z1", *[F.col(f"__first.{c}").alias(c) for c in rest], "sentence", "source", "n_tuples")


def page(by_anchor: DataFrame, returned: int, cursor: int = -1) -> DataFrame:
    """The next anchors after the cursor."""
    return by_anchor.where(F.col("z1") > cursor).orderBy("z1").limit(returned)


def summary(by_anchor: DataFrame, last: int) -> DataFrame:
    """found_all (tuples), last_pos (``last``: the last anchor shown, or the cursor) and progress: tuples up to that anchor, if it has any. One scan."""
    upto = F.coalesce(F.sum(F.when(F.col("z1") <= last, F.col("n_tuples"))), F.lit(0))
    there = F.coalesce(F.max(F.col("z1") == last), F.lit(False))
    return by_anchor.agg(F.coalesce(F.sum("n_tuples"), F.lit(0)).alias("found_all"), F.lit(last).cast("bigint").alias("last_pos"), F.when(there, upto).otherwise(F.lit(0)).cast("bigint").alias("progress"))
