"""Ordered, versioned key/value collections over an append-only log.

A log has ``collection, key, value, txn_id, seq, is_deleted, generation``. What a snapshot sees of a key is its version
of the highest ``(txn_id, seq)`` not above the snapshot, in whatever generation it lies; of versions that are equal in both that
of the highest generation, then a tombstone, then the greatest value. A tombstone hides the key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "collection string, key string, value string, txn_id long, seq long, is_deleted boolean, generation int"


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``collection, key, value, txn_id`` as a snapshot sees them. One aggregation, combined before its shuffle."""
    if snapshot is not None:
        log = log.where(F.col("txn_id") <= snapshot)
    newest = F.max_by(F.struct("value", "is_deleted", "txn_id"), F.struct("txn_id", "seq", "generation", "is_deleted", "value")).alias("v")
    return log.groupBy("collection", "key").agg(newest).where("not v.is_deleted").select("collection", "key", "v.value", "v.txn_id")


class Collection:
    """A named collection at a snapshot. Filters on keys reach the scan of the log below the aggregation."""

    def __init__(self, log: DataFrame, name: str, snapshot: int | None = None):
        self.log, self.name, self.snapshot = log.where(F.col("collection") == name), name, snapshot

    def current(self) -> DataFrame:
        return latest(self.log, self.snapshot).select("key", "value")

    def get(self, key: str) -> DataFrame:
        """The value of a key: one row or none."""
        return self.current().where(F.col("key") == key)

    def multi_get(self, keys: list[str] | DataFrame) -> DataFrame:
        """``pos, key, value`` of keys in the order asked; misses have no value.

        A list is a literal of the plan; a DataFrame (``pos, key``) is joined by whichever way suits its size.
        """
        if isinstance(keys, DataFrame):
            wanted, log = keys.select("pos", "key"), self.log.join(keys.select("key"), "key", "left_semi")
        else:
            wanted = self.log.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
            log = self.log.where(F.col("key").isin(keys))
        found = latest(log, self.snapshot).select("key", "value")
        return wanted.join(found, "key", "left").select("pos", "key", "value")

    def range(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Keys from start (included) to end (excluded), in order; null or empty: unbounded."""
        out = self.current()
        if start:
            out = out.where(F.col("key") >= start)
        if end:
            out = out.where(F.col("key") < end)
        return out.orderBy("key")

    def scan(self) -> DataFrame:
        return self.range()

    def prefix(self, prefix: str) -> DataFrame:
        return self.current().where(F.col("key").startswith(prefix)).orderBy("key")

    def cursor(self, start: str | None = None, end: str | None = None) -> Iterator[tuple[str, str]]:
        """Keys and values in order, fetched partition by partition."""
        for row in self.range(start, end).toLocalIterator():
            yield row["key"], row["value"]

    def count(self) -> int:
        return self.current().count()


def merge_generations(*logs: DataFrame) -> DataFrame:
    """Logs of several generations as one; a tombstone of any generation hides older versions of all."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def compact(log: DataFrame, generation: int) -> DataFrame:
    """A log of a new generation with nothing but what is visible; names, keys and ids stay."""
    return latest(log).select("collection", "key", "value", "txn_id", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("is_deleted"), F.lit(generation).alias("generation"))


def statistics(log: DataFrame) -> DataFrame:
    """Per collection: counters as writes keep them, and the true number of live keys.

    ``logical_item_count``: one up for each insert (an overwrite too), one down for each removal (a miss too).
    ``live_record_bytes``: keys, values and 24 bytes of header of all inserts, never less.
    """
    inserted = ~F.col("is_deleted")
    size = F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit(""))) + 24
    counts = log.groupBy("collection").agg(
        F.sum(F.when(inserted, 1).otherwise(-1)).cast("long").alias("logical_item_count"),
        F.coalesce(F.sum(F.when(inserted, size)), F.lit(0)).cast("long").alias("live_record_bytes"),
        F.countDistinct("generation").alias("generations"),
    )
    live = latest(log).groupBy("collection").agg(F.count(F.lit(1)).alias("live_keys"))
    return counts.join(live, "collection", "left").select("collection", "logical_item_count", "live_record_bytes", F.coalesce("live_keys", F.lit(0)).alias("live_keys"), "generations")


def database_summary(log: DataFrame) -> DataFrame:
    per = statistics(log)
    return per.agg(F.sum("logical_item_count").alias("logical_item_count"), F.sum("live_record_bytes").alias("live_record_bytes"), F.sum("live_keys").alias("live_keys"), F.max("generations").alias("generations"), F.count(F.lit(1)).alias("collections"))
