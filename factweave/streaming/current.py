"""A version log as a stream: segments are read as they come, and a table of current values is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators import kv
from factweave.sources import sizes


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a log folder as a stream."""
    return spark.readStream.schema(kv.LOG).option("recursiveFileLookup", "true").parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """What is visible, as a streaming aggregation for output mode ``complete`` or ``update`` (tombstones included there)."""
    newest = F.max_by(F.struct("value", "is_deleted", "txn_id"), F.struct("txn_id", "seq")).alias("v")
    return log.groupBy("collection", "key").agg(newest).select("collection", "key", "v.value", "v.txn_id", "v.is_deleted")


def maintain(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps one folder per batch under ``path``: the newest version of each key so far, tombstones too.

    A batch that is run again gives the same folder, so the result is exact once. Folders of older batches but the last
    one go. Versions are dealt out by key and size before they are compared: comparing structs with texts sorts, and a task would
    sort all of a large file.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[6:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("batch-"))
        before = [n for n in done if n < number]
        rows = batch.select("collection", "key", "value", "txn_id", "seq", "is_deleted")
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch-{before[-1]}"))
        version = F.max(F.struct("txn_id", "seq", "is_deleted", "value")).alias("v")
        rows = sizes.spread(rows, "collection", "key")
        rows.groupBy("collection", "key").agg(version).select("collection", "key", "v.*").write.mode("overwrite").parquet(f"{path}/batch-{number}")
        for old in before[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{old}"), True)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``maintain`` keeps, without tombstones."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[6:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch-"))
    return spark.read.parquet(f"{path}/batch-{last}").where("not is_deleted").select("collection", "key", "value", "txn_id")
