"""Readers of a property graph: ``props`` (facts) and ``edges`` (relationships)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import sets
from factweave.sources import sizes

Source = DataFrame | Callable[[], DataFrame]


class Graph:
    """A graph of two DataFrames. A literal field or relationship prunes partitions where they are partition columns.

    ``by_object``: the same facts in a layout that suits reading whole objects, where there is one. Each of the three
    may be a function that gives the DataFrame when it is first asked for.
    """

    def __init__(self, props: Source, edges: Source, by_object: Source | None = None):
        self._props, self._edges, self._by_object = props, edges, by_object

    @cached_property
    def props(self) -> DataFrame:
        return self._props() if callable(self._props) else self._props

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges() if callable(self._edges) else self._edges

    @cached_property
    def by_object(self) -> DataFrame:
        return self.props if self._by_object is None else self._by_object() if callable(self._by_object) else self._by_object

    @classmethod
    def read(cls, spark, path: str) -> "Graph":
        """A graph that ``write`` laid down."""
        return cls(spark.read.parquet(f"{path}/props"), spark.read.parquet(f"{path}/edges"))

    def write(self, path: str) -> None:
        """Properties by field and relationships by type, so one of either is a folder of its own.

        Rows are dealt out by ranges of folder and id, as many as their size asks for, so a folder of many rows has many files, each of
        its own ids, and what a task sorts by folders doesn't grow.
        """
        sizes.spread_by_range(self.props, "field", "obj_id").write.partitionBy("field").parquet(f"{path}/props")
        sizes.spread_by_range(self.edges, "rel", "src").write.partitionBy("rel").parquet(f"{path}/edges")

    # properties
    def facts(self, obj_id: int) -> DataFrame:
        """``obj_id, field, value``: properties, then targets of relationships, as text."""
        own = self.by_object.where(F.col("obj_id") == obj_id).select("obj_id", "field", value_text().alias("value"))
        out = self.edges.where(F.col("src") == obj_id).select(F.col("src").alias("obj_id"), F.col("rel").alias("field"), F.col("dst").cast("string").alias("value"))
        return own.unionByName(out)

    def string(self, obj_id: int, field: str) -> DataFrame:
        return self.props.where((F.col("obj_id") == obj_id) & (F.col("field") == field) & (F.col("vtype") == "string")).select("obj_id", F.col("sval").alias("value"))

    def numeric(self, obj_id: int, field: str) -> DataFrame:
        """A number, or the geohash of a place."""
        return self.props.where((F.col("obj_id") == obj_id) & (F.col("field") == field) & F.col("vtype").isin("numeric", "geo")).select("obj_id", F.col("nval").alias("value"))

    def by_property(self, field: str, value: str | int | bool) -> DataFrame:
        """Ids of objects whose field has the value; text, or a number (booleans: 0 and 1)."""
        own = self.props.where(F.col("field") == field)
        if isinstance(value, str):
            own = own.where((F.col("vtype") == "string") & (F.col("sval") == value))
        else:
            own = own.where((F.col("vtype") == "numeric") & (F.col("nval") == int(value)))
        return own.select("obj_id").distinct()

    def by_range(self, field: str, low: int | None = None, high: int | None = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
        """Ids of objects whose number lies between the bounds; both belong to the range unless they are open."""
        n = F.col("nval")
        own = self.props.where((F.col("field") == field) & (F.col("vtype") == "numeric"))
        if low is not None:
            own = own.where(n > low if low_open else n >= low)
        if high is not None:
            own = own.where(n < high if high_open else n <= high)
        return own.select("obj_id").distinct()

    def at_place(self, field: str, lat: float, lon: float) -> DataFrame:
        """Ids of objects in the very cell of a place."""
        return self.props.where((F.col("field") == field) & (F.col("vtype") == "geo") & (F.col("nval") == S.geohash64(F.lit(lat), F.lit(lon)))).select("obj_id").distinct()

    def near(self, field: str, lat: float, lon: float, metres: float, mode: str = "zrange") -> DataFrame:
        """Ids of objects near a place.

        ``zrange``: geohashes between those of the corners of the square around it, which may hold places outside;
        ``radius``: places in the square and within the distance.
        """
        places = self.props.where((F.col("field") == field) & (F.col("vtype") == "geo"))
        south, north, west, east = S.degrees_box(F.lit(lat), F.lit(lon), F.lit(metres))
        if mode == "radius":
            inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
            return places.where(inside & (S.haversine("lat", "lon", F.lit(lat), F.lit(lon)) <= metres)).select("obj_id").distinct()
        if mode != "zrange":
            raise ValueError("mode must be 'zrange' or 'radius'")
        a, b = S.geohash_order(S.geohash64(south, west)), S.geohash_order(S.geohash64(north, east))
        return places.where(S.geohash_order(F.col("nval")).between(F.least(a, b), F.greatest(a, b))).select("obj_id").distinct()

    def count_by_property(self, field: str, value: str | int) -> DataFrame:
        return self.by_property(field, value).agg(F.count(F.lit(1)).alias("n"))

    def without(self, field: str) -> DataFrame:
        """Ids of objects that lack a field."""
        return sets.and_not(sets.ids(self.by_object), self.props.where(F.col("field") == field).select("obj_id"))

    # relationships
    def relationship_types(self) -> DataFrame:
        return self.edges.select("rel").distinct()

    def count_relationships(self, rel: str | None = None) -> DataFrame:
        """``n`` of a type, or ``rel, n`` of all types."""
        if rel is None:
            return self.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
        return self.edges.where(F.col("rel") == rel).agg(F.count(F.lit(1)).alias("n"))

    def outgoing(self, src: int, rel: str) -> DataFrame:
        return sets.ids(self.edges.where((F.col("src") == src) & (F.col("rel") == rel)), "dst")

    def incoming(self, dst: int, rel: str) -> DataFrame:
        return sets.ids(self.edges.where((F.col("dst") == dst) & (F.col("rel") == rel)), "src")

    def hop(self, ids: DataFrame, direction: str, rel: str) -> DataFrame:
        """What a set of ids is related to. Spark broadcasts the smaller side when its measured size allows."""
        if direction not in ("in", "out"):
            raise ValueError("direction must be 'in' or 'out'")
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        own = self.edges.where(F.col("rel") == rel)
        return sets.ids(own.join(ids.select(F.col("obj_id").alias("at")), own[near] == F.col("at"), "left_semi"), far)

    def related(self, pairs: DataFrame, rel: str) -> DataFrame:
        """``src, dst, related`` of pairs of ids."""
        met = self.edges.where(F.col("rel") == rel).select("src", "dst", F.lit(True).alias("met")).distinct()
        return pairs.select("src", "dst").join(met, ["src", "dst"], "left").select("src", "dst", F.coalesce("met", F.lit(False)).alias("related"))

    def has_relationship(self, src: int, rel: str, dst: int) -> bool:
        return not self.edges.where((F.col("src") == src) & (F.col("rel") == rel) & (F.col("dst") == dst)).isEmpty()

    def mutual(self, rel: str) -> DataFrame:
        """``a, b`` (a < b) of objects that are related both ways."""
        own = self.edges.where(F.col("rel") == rel).select("src", "dst")
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return own.where("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()

    def common_neighbours(self, a: int, b: int, rel: str) -> DataFrame:
        return sets.intersect(self.outgoing(a, rel), self.outgoing(b, rel))


def value_text() -> Column:
    """A property's value as text: a number and a geohash as an unsigned or signed decimal."""
    return F.when(F.col("vtype") == "string", F.col("sval")).when(F.col("vtype") == "geo", S.unsigned(F.col("nval")).cast("string")).otherwise(F.col("nval").cast("string"))
