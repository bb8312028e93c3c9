"""Session helpers: the shared folder, lineage cuts, and columns that may be missing or clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: documents may be long, and the default of 10,000 can be a gigabyte.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexigrid/{label}-{uuid.uuid4().hex}"


#: Rows of ids or hashes up to which they are broadcast (8 bytes each); beyond it, tables are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def save(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it outlives any executor. ``scratch`` gets its path, for discard()."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing will read again: what was made of them has been saved."""
    for at in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small enough for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (so no other column can clash), without rows that lack either."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for a broadcast if a saved table has few enough rows."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in the one column of ids, a saved table; a null doc_id never is.

    Up to BROADCAST_ROWS ids are broadcast, so that the documents stay where they are."""
    name = free_name(docs, "__gone")
    return docs.join(small(ids.toDF(name)), F.col("doc_id") == F.col(name), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
