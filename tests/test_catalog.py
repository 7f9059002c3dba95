import duckdb
import pytest

from factweave import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(str(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf, connection, name):
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = normal(tuple(r) for r in found.select(*columns).collect())
    expected = connection.sql(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall()
    assert rows == normal(expected)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0


def test_derived_graph(spark, sf):
    counts = {r["rel"]: r["n"] for r in catalog.QUERIES["g_count_rel"](spark, sf).collect()}
    assert {k: counts[k] for k in ("PLACED", "CONTAINS", "SUPPLIES", "KNOWS")} == {"PLACED": 1500, "CONTAINS": 5942, "SUPPLIES": 1905, "KNOWS": 618}
    assert catalog.QUERIES["g_triangles"](spark, sf).first()["triangles"] == 76
    assert catalog.QUERIES["g_mutual"](spark, sf).count() == 30
    path = [r["obj_id"] - catalog._C for r in catalog.QUERIES["g_shortest_path"](spark, sf).orderBy("pos").collect()]
    assert path == [3, 4, 6, 8, 57, 100]


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["kv_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    plan = catalog.QUERIES["g_by_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # a literal field leaves the two tables that have it, and one column of each beside the key
    assert plan.count("FileScan") == 2 and "c_mktsegment" not in plan
