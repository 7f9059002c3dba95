"""Queries over schemaless text documents (``ns``, ``id``, ``doc``: a map of texts)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as S


class Op(Enum):
    EQ, GT, LT, GTE, LTE, BETWEEN, PREFIX = "eq", "gt", "lt", "gte", "lte", "between", "prefix"


def _compare(value: Column, op: Op, a, b) -> Column:
    if op is Op.EQ:
        return value == a
    if op is Op.GT:
        return value > a
    if op is Op.LT:
        return value < a
    if op is Op.GTE:
        return value >= a
    if op is Op.LTE:
        return value <= a
    if op is Op.BETWEEN:
        return value.between(a, b)
    raise ValueError(f"{op} is no comparison of this type")


class DocQuery:
    """A builder whose steps return new builders. Conditions are joined with AND; without any the result is empty."""

    def __init__(self, docs: DataFrame, ns: str, conditions: tuple[Column, ...] = (), fields: tuple[str, ...] = (), most: int | None = None):
        self.docs, self.ns, self.conditions, self.fields, self.most = docs, ns, conditions, fields, most

    def _with(self, **changes) -> "DocQuery":
        return DocQuery(**({"docs": self.docs, "ns": self.ns, "conditions": self.conditions, "fields": self.fields, "most": self.most} | changes))

    def where(self, attribute: str, op: Op, value: int, upper: int | None = None) -> "DocQuery":
        """A numeric condition; fields that are no whole unsigned numbers never match."""
        if op is Op.PREFIX:
            raise ValueError("a prefix is a condition on text")
        if op is Op.BETWEEN and upper is None:
            raise ValueError("between needs two values")
        return self._with(conditions=(*self.conditions, _compare(S.to_number(F.col("doc")[attribute]), op, value, upper)))

    def where_string(self, attribute: str, op: Op, value: str, upper: str | None = None) -> "DocQuery":
        """A condition on text, in the order of its bytes."""
        field = F.col("doc")[attribute]
        return self._with(conditions=(*self.conditions, field.startswith(value) if op is Op.PREFIX else _compare(field, op, value, upper)))

    def select(self, *fields: str) -> "DocQuery":
        return self._with(fields=fields)

    def limit(self, n: int) -> "DocQuery":
        """The first n by ascending id."""
        return self._with(most=n)

    def execute(self) -> DataFrame:
        """``id`` and the chosen fields, or the whole map."""
        out = self.docs.where(F.col("ns") == self.ns)
        if not self.conditions:
            out = out.limit(0)
        for c in self.conditions:
            out = out.where(c)
        out = out.select("id", *(F.col("doc")[f].alias(f) for f in self.fields)) if self.fields else out.select("id", "doc")
        return out.orderBy("id").limit(self.most) if self.most is not None else out


def numeric_index_entries(docs: DataFrame, attribute: str) -> DataFrame:
    """``key, id``: index keys of a number, padded so that they sort by it; fields that are no whole unsigned numbers have none."""
    number = S.to_number(F.col("doc")[attribute])
    return docs.where(number.isNotNull()).select(F.concat_ws(":", S.sortable_key(F.concat_ws(":", F.lit("idx"), "ns", F.lit(attribute)), number), F.col("id").cast("string")).alias("key"), "id")


def without_documents(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Index keys without those of deleted documents (``id``)."""
    return entries.join(gone.select("id").distinct(), "id", "left_anti").select("key", "id")


def index_entries(docs: DataFrame, attribute: str) -> DataFrame:
    """``key, id``: text index keys of a field, as an embedded store would keep them."""
    return docs.where(F.col("doc")[attribute].isNotNull()).select(F.concat_ws(":", F.lit("idx_str"), "ns", F.lit(attribute), F.col("doc")[attribute], F.col("id").cast("string")).alias("key"), "id")
