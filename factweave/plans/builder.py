"""Step plans over a graph: find, filter, unite and traverse, folded into one lazy DataFrame of ids.

The builder makes immutable steps; nothing runs before an action on the result. Steps that need several properties
of one object at once (``find`` and ``filter`` by several fields) are one aggregation over the facts instead of a
chain of joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import sets
from factweave.operators.graph import Graph
from factweave.operators.results import ResultSet


@dataclass(frozen=True)
class Find:
    """Replaces the current ids with objects that match all criteria."""

    criteria: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Intersect:
    criteria: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Union:
    criteria: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Traverse:
    direction: str
    rel: str
    criteria: tuple[tuple[str, object], ...] = ()


Step = Find | Intersect | Union | Traverse


def _criteria(properties: Mapping) -> tuple[tuple[str, object], ...]:
    if not isinstance(properties, Mapping):
        raise TypeError("criteria are a mapping from fields to values")
    for field, value in properties.items():
        if value is None:
            raise ValueError(f"{field} has no value")
    return tuple(properties.items())


def matches(field: str, value) -> Column:
    """The condition on a fact for one criterion.

    Text and numbers are compared by type. ``{gte, lte, gt, lt}``: a range, whose missing ends are open;
    ``{lat, lon}``: the very cell of a place; ``{near: {lat, lon}, radius: metres, mode}``: places around one.
    """
    own = F.col("field") == field
    if isinstance(value, Mapping):
        if "near" in value:
            at, metres = value["near"], float(value["radius"])
            places = own & (F.col("vtype") == "geo")
            south, north, west, east = S.degrees_box(F.lit(float(at["lat"])), F.lit(float(at["lon"])), F.lit(metres))
            if value.get("mode", "zrange") == "radius":
                return places & F.col("lat").between(south, north) & F.col("lon").between(west, east) & (S.haversine("lat", "lon", F.lit(float(at["lat"])), F.lit(float(at["lon"]))) <= metres)
            a, b = S.geohash_order(S.geohash64(south, west)), S.geohash_order(S.geohash64(north, east))
            return places & S.geohash_order(F.col("nval")).between(F.least(a, b), F.greatest(a, b))
        if set(value) == {"lat", "lon"}:
            return own & (F.col("vtype") == "geo") & (F.col("nval") == S.geohash64(F.lit(float(value["lat"])), F.lit(float(value["lon"]))))
        if value and set(value) <= {"gte", "lte", "gt", "lt"}:
            n = F.col("nval")
            ends = {"gte": lambda x: n >= x, "lte": lambda x: n <= x, "gt": lambda x: n > x, "lt": lambda x: n < x}
            return reduce(lambda a, b: a & b, (ends[k](int(x)) for k, x in value.items()), own & (F.col("vtype") == "numeric"))
        raise ValueError(f"{field}: not a criterion: {value!r}")
    if isinstance(value, (bool, int, float)):
        return own & (F.col("vtype") == "numeric") & (F.col("nval") == int(value))
    if isinstance(value, str):
        return own & (F.col("vtype") == "string") & (F.col("sval") == value)
    raise ValueError(f"{field}: not a criterion: {value!r}")


def matching(props: DataFrame, criteria: Sequence[tuple[str, object]]) -> DataFrame:
    """Ids of objects that meet all criteria: one scan, one aggregation."""
    tests = [matches(f, v) for f, v in criteria]
    rows = props.where(reduce(lambda a, b: a | b, tests))
    if len(tests) == 1:
        return rows.select("obj_id").distinct()
    met = rows.groupBy("obj_id").agg(*(F.max(F.coalesce(t, F.lit(False))).alias(f"m{k}") for k, t in enumerate(tests)))
    return met.where(reduce(lambda a, b: a & b, (F.col(f"m{k}") for k in range(len(tests))))).select("obj_id")


def compile_plan(graph: Graph, steps: Sequence[Step]) -> DataFrame:
    """The ids that the steps leave."""
    if not isinstance(steps, (list, tuple)):
        raise TypeError("a plan is a list of steps")
    if not steps:
        raise ValueError("a plan needs a step")
    current: DataFrame | None = None
    for step in steps:
        if isinstance(step, Find):
            current = matching(graph.props, step.criteria) if step.criteria else graph.props.select("obj_id").limit(0)
        elif current is None:
            raise ValueError("a plan starts with a find")
        elif isinstance(step, Traverse):
            current = graph.hop(current, step.direction, step.rel)
            if step.criteria:
                current = sets.intersect(current, matching(graph.props, step.criteria))
        elif isinstance(step, Intersect):
            current = sets.intersect(current, matching(graph.props, step.criteria)) if step.criteria else current
        elif isinstance(step, Union):
            current = sets.union(current, matching(graph.props, step.criteria)) if step.criteria else current
        else:
            raise TypeError(f"not a step: {step!r}")
    return current


@dataclass(frozen=True)
class Query:
    """``Query(graph).find({...}).traverse("out", "KNOWS").execute()``."""

    graph: Graph
    steps: tuple[Step, ...] = ()

    def _then(self, *steps: Step) -> "Query":
        return replace(self, steps=(*self.steps, *steps))

    def find(self, criteria: Mapping | Sequence[Mapping]) -> "Query":
        """All of a mapping's criteria. Of a list the groups are folded from the left: each later one adds objects that meet
        its first criterion to all found so far, and narrows the whole by its others."""
        if isinstance(criteria, Mapping):
            return self._then(Find(_criteria(criteria)))
        if not isinstance(criteria, Sequence) or isinstance(criteria, str):
            raise TypeError("criteria are a mapping or a list of them")
        groups = [_criteria(g) for g in criteria]
        steps: list[Step] = []
        for k, group in enumerate(groups):
            if k == 0:
                steps.append(Find(group))
            else:
                steps.append(Union(group[:1]))
                if group[1:]:
                    steps.append(Intersect(group[1:]))
        return self._then(*steps)

    def filter(self, criteria: Mapping) -> "Query":
        return self._then(Intersect(_criteria(criteria)))

    def union(self, criteria: Mapping) -> "Query":
        """Adds objects that meet any of the criteria."""
        return self._then(*(Union((c,)) for c in _criteria(criteria)))

    def traverse(self, direction: str, rel: str, criteria: Mapping | None = None) -> "Query":
        if direction not in ("in", "out"):
            raise ValueError("direction must be 'in' or 'out'")
        return self._then(Traverse(direction, rel, _criteria(criteria or {})))

    def ids(self) -> DataFrame:
        return compile_plan(self.graph, list(self.steps))

    def execute(self) -> ResultSet:
        return ResultSet(self.graph.by_object, self.ids(), not any(isinstance(s, Traverse) and not s.criteria for s in self.steps))
