"""Connected components of an edge table, by alternating star contraction; only tables of ids move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, save


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node of each node's component. edges has columns a, b; nulls and loops are dropped.

    Each round hooks every node's neighbours onto its smallest neighbour, then once more for larger neighbours alone; the rounds
    needed grow with the logarithm of the largest component's diameter. Each round's table goes to the shared folder."""
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    scratch: list[str] = []
    current = save(both, label, scratch)
    while True:
        # large star: neighbours greater than u are linked to u's smallest neighbour or itself
        sym = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        near = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.join(near, "u").where("v > u").select(F.least("u", "m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi")
        # small star: smaller neighbours and u itself are linked to the smallest of them
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        following = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).where("lo <> hi").distinct()
        old, scratch = scratch, []
        following = save(following, label, scratch)
        discard(spark, old)
        # a star forest: no node is both a root and a leaf, and each leaf has one root
        leaves = following.groupBy(F.col("hi").alias("leaf")).agg(F.count("*").alias("n"))
        done = leaves.where("n > 1").isEmpty() and following.join(leaves, F.col("lo") == F.col("leaf"), "left_semi").isEmpty()
        current = following
        if done:
            break
    roots = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
