"""Sets of ids: DataFrames of one column ``obj_id`` without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids(df: DataFrame, column: str = "obj_id") -> DataFrame:
    return df.select(F.col(column).cast("long").alias("obj_id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "obj_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "obj_id", "left_anti")


def cardinality(a: DataFrame) -> int:
    return a.count()


def is_empty(a: DataFrame) -> bool:
    return a.isEmpty()


def bitmaps(a: DataFrame) -> DataFrame:
    """The set as one bitmap per bucket of 32,768 ids: compact, and mergeable with ``bitmap_or_agg``."""
    return a.groupBy(F.call_function("bitmap_bucket_number", "obj_id").alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("obj_id"))).alias("bits"))


def from_bitmaps(maps: DataFrame) -> DataFrame:
    """The ids of bitmaps by bucket. Bucket 0 holds 0 and counts down, those from 1 on hold what is above 0."""
    size = 32_768
    byte = lambda k: F.conv(F.hex(F.substring(F.col("bits"), (k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    places = maps.select("bucket", F.explode(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.call_function("getbit", byte(k), (k % 8).cast("int")) == 1)).alias("place"))
    above = (F.col("bucket") - 1) * size + F.col("place") + 1
    return places.select(F.when(F.col("bucket") > 0, above).otherwise(F.col("bucket") * size - F.col("place")).cast("long").alias("obj_id"))
