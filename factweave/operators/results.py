"""Results: ordered pages of rows or of assembled objects."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.graph import value_text

PAGE, SIZE = 1, 50


def page(rows: DataFrame, order: str, number: int = PAGE, size: int = SIZE) -> DataFrame:
    """Page ``number`` (from 1) in ascending order; beyond the end it is empty. Only a top-n sort, no global one."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1, and have at least one row")
    return rows.orderBy(order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, order: str, last=None, size: int = SIZE) -> DataFrame:
    """The page that follows the key ``last`` (the first one if there is none): it costs the same however far in it lies."""
    return page(rows if last is None else rows.where(F.col(order) > last), order, PAGE, size)


def page_totals(rows: DataFrame, number: int = PAGE, size: int = SIZE) -> DataFrame:
    """One row: ``total_results, total_pages, page, results_in_page``."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1, and have at least one row")
    total = F.col("total_results")
    return rows.agg(F.count(F.lit(1)).alias("total_results")).select(
        "total_results", F.ceil(total / size).cast("long").alias("total_pages"), F.lit(number).cast("long").alias("page"), F.greatest(F.lit(0), F.least(F.lit(size), total - (number - 1) * size)).cast("long").alias("results_in_page")
    )


def objects_map(props: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``obj_id, object``: a map from field to value as text. Relationships are left out, and so are objects without properties."""
    if ids is not None:
        props = props.join(ids, "obj_id", "left_semi")
    entries = F.sort_array(F.collect_list(F.struct("field", value_text().alias("value"))), asc=False)
    # a field has one value; of several that were written side by side the greatest text
    one = F.filter("entries", lambda e, i: (i == 0) | (F.get(F.col("entries"), i - 1)["field"] != e["field"]))
    return props.groupBy("obj_id").agg(entries.alias("entries")).select("obj_id", F.map_from_entries(F.reverse(one)).alias("object"))


def objects_wide(props: DataFrame, fields: list[str], ids: DataFrame | None = None) -> DataFrame:
    """``obj_id`` and a column for each of the named fields, as text."""
    if ids is not None:
        props = props.join(ids, "obj_id", "left_semi")
    return props.where(F.col("field").isin(fields)).withColumn("value", value_text()).groupBy("obj_id").pivot("field", fields).agg(F.first("value"))


class ResultSet:
    """Ids and the facts from which their objects are made. Ids without properties count nowhere.

    ``real``: the ids are known to have properties, as those that were found by one are.
    """

    def __init__(self, props: DataFrame, ids: DataFrame, real: bool = False):
        self.props, self.ids, self.real = props, ids, real

    def _real(self) -> DataFrame:
        return self.ids if self.real else self.ids.join(self.props.select("obj_id"), "obj_id", "left_semi")

    def total_count(self) -> int:
        return self._real().count()

    def page(self, number: int = PAGE, size: int = SIZE) -> DataFrame:
        """Objects of a page by ascending id; only the ids of the page meet the facts."""
        return objects_map(self.props, page(self._real(), "obj_id", number, size)).orderBy("obj_id")

    def page_after(self, last: int | None = None, size: int = SIZE) -> DataFrame:
        """Objects of the page whose ids follow ``last``."""
        return objects_map(self.props, page_after(self._real(), "obj_id", last, size)).orderBy("obj_id")

    def totals(self, number: int = PAGE, size: int = SIZE) -> DataFrame:
        return page_totals(self._real(), number, size)

    def objects(self) -> DataFrame:
        return objects_map(self.props, self.ids)

    def wide(self, fields: list[str]) -> DataFrame:
        return objects_wide(self.props, fields, self.ids)

    def __iter__(self) -> Iterator[dict]:
        for row in self.objects().orderBy("obj_id").toLocalIterator():
            yield {"id": row["obj_id"], **row["object"]}
