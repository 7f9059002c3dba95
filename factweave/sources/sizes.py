"""Shuffles into as many partitions as the size of what goes in asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for a task: some 400,000 facts or relationships of the derived graph, more of a log's segments.
TASK = 4 << 20
#: Above this an estimate is what Spark takes where it knows no size.
_UNKNOWN = 1 << 50


def parts(df: DataFrame) -> int | None:
    """Partitions in proportion to the files that a frame comes from, counted once for each scan; no rows are read.

    A task's share so stays the same however large the input is. Frames that come from elsewhere have no size: if all do, there is no number,
    if some do, it is the session's at least.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = [n for n in found if n < _UNKNOWN]
    if found and not known:
        return None
    least = 1 if len(known) == len(found) else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(known) // TASK))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in partitions by size."""
    n = parts(df)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def spread_by_range(df: DataFrame, *keys: str) -> DataFrame:
    n = parts(df)
    return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
