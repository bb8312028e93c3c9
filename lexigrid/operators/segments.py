"""Segments between punctuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.tokens import PUNCTUATION


def without_punctuation(tokens: DataFrame) -> DataFrame:
    """Tokens whose tag set isn't one of the punctuation sets, with ``segment``: how many such tokens the sentence had before."""
    mark = F.col("tags").isin(*PUNCTUATION)
    so_far = Window.partitionBy("sentence").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("segment", F.sum(mark.cast("bigint")).over(so_far)).where(~mark)
