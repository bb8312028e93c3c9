"""Sentences that arrive in files: counts of token types are kept up to date with each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.sources.tagged import stripped, tokens_of

TYPE = ["word_case", "word", "lemma", "tags"]


def parsed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """word_case, word, lemma, tags of the tokens in files of tagged lines that arrive in a folder, as the batch parser makes them."""
    lines = spark.readStream.text(folder)
    return lines.select(F.explode(tokens_of(stripped(F.col("value")))).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in TYPE])


def maintain_counts(stream: DataFrame, table: str, checkpoint: str):
    """Write each micro-batch's counts under its number: a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*TYPE).agg(F.count("*").alias("freq")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy(*TYPE).agg(F.sum("freq").alias("freq"))
