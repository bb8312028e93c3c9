"""Dense numbers in a global order, without a window over rows or buckets.

Rows are range-partitioned and sorted, and each keeps its place within its partition; that table is stored. Partitions are counted, and the running
total over them, a row a partition, makes places global numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.sources.shared import stored

#: monotonically_increasing_id() has the partition above this bit, and the place in it below.
PLACE_BITS = 33


def part_of(at: str) -> Column:
    return F.shiftright(at, PLACE_BITS)


def place_of(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def starts(rows: DataFrame, **ats: str) -> DataFrame:
    """__part and, by name, the number of places before each partition; ``ats``: columns of places (equal ones are of one thing). A row a partition."""
    first = next(iter(ats.values()))
    sizes = rows.groupBy(part_of(first).alias("__part")).agg(*[(F.max(place_of(at)) + 1).alias(name) for name, at in ats.items()])
    # no more rows than partitions
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.broadcast(sizes.select("__part", *[(F.sum(name).over(before) - F.col(name)).alias(name) for name in ats]))


def numbered(df: DataFrame, name: str, order: list[Column], within: str | None = None) -> DataFrame:
    """df with a 0-based ``name``: the rank by ``order``; with ``within``, a column of few values, apart for each of them."""
    order = [F.col(within), *order] if within else order
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), f"numbered-{name}")
    out = rows.join(starts(rows, __start="__at"), part_of("__at") == F.col("__part")).withColumn(name, F.col("__start") + place_of("__at"))
    if within:
        least = out.groupBy(F.col(within).alias("__w")).agg(F.min(name).alias("__least"))
        out = out.join(F.broadcast(least), F.col(within).eqNullSafe(F.col("__w"))).withColumn(name, F.col(name) - F.col("__least"))
    return out.select(*df.columns, F.col(name).cast("bigint").alias(name))
