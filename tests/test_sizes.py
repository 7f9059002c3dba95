"""What a task holds goes by the size of the input, not by the session's number of partitions (4 here)."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import algorithms, facts, graph_transactions, kv
from factweave.operators.graph import Graph
from factweave.operators.transactions import Database
from factweave.sources import sizes
from factweave.sources import tables as T
from factweave.streaming import current


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(sizes, "TASK", 1000)


def test_relationships_are_told_apart_in_parts_by_size(spark, sf, small_tasks):
    edges = T.edges(spark, sf, ("CONTAINS",))
    assert edges.rdd.getNumPartitions() > 4 and edges.count() == edges.distinct().count() == 5942
    again = facts.insert_edges(edges, edges.limit(10))
    assert again.rdd.getNumPartitions() > 4 and again.count() == 5942
    assert sizes.parts(facts.edge_rows(spark, [(1, "K", 2)])) is None and facts.insert_edges(facts.edge_rows(spark, [(1, "K", 2)]), facts.edge_rows(spark, [(1, "K", 2)])).count() == 1


def test_a_stream_is_folded_in_parts_by_size(spark, sf, tmp_path, small_tasks):
    path, out, seen = (f"file://{tmp_path}/{x}" for x in ("log", "out", "seen"))
    log = T.user_log(spark, sf)
    log.write.parquet(f"{path}/1")
    spark.createDataFrame([("tie", "k", "a", 1, 0, False, 0), ("tie", "k", None, 1, 0, True, 0)], kv.LOG).write.parquet(f"{path}/2")
    current.maintain(current.log_stream(spark, path), out, seen).awaitTermination(120)
    assert len(list((tmp_path / "out/batch-0").glob("part-*.parquet"))) > 4
    assert sorted(current.current(spark, out).collect()) == sorted(kv.latest(log).select("collection", "key", "value", "txn_id").collect())


def test_relationships_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Of files so small that Spark would send them to all: only a side known to have few rows may be."""
    facts.edge_rows(spark, [(k, "K", k + 1) for k in range(1, 30)] + [(1, "K", 3), (2, "K", 4)]).write.parquet(f"{tmp_path}/edges")
    edges, plans = spark.read.parquet(f"{tmp_path}/edges"), []
    kept = algorithms.checkpoint

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(algorithms, "checkpoint", watched)
    for few in (0, 50_000):
        monkeypatch.setattr(algorithms, "FEW", few, raising=False)
        plans.clear()
        assert [r["obj_id"] for r in algorithms.shortest_path(edges, 1, 7, "K").orderBy("pos").collect()] == [1, 2, 4, 5, 6, 7]
        assert any("Join" in p for p in plans) and all(("Broadcast" in p) == bool(few) for p in plans if "Join" in p)


def test_a_graph_is_laid_down_in_parts_by_size(spark, sf, tmp_path, small_tasks):
    Graph(T.props(spark, sf, ("part",)), T.edges(spark, sf, ("PLACED",))).write(f"{tmp_path}/g")
    assert len(list((tmp_path / "g/props/field=type").glob("*.parquet"))) > 4 and len(list((tmp_path / "g/edges/rel=PLACED").glob("*.parquet"))) > 4
    again = Graph.read(spark, f"{tmp_path}/g")
    assert again.edges.count() == 1500 and again.props.agg(F.countDistinct("obj_id").alias("n")).first()["n"] == T.table(spark, sf, "part").count()


def test_a_snapshot_is_compared_in_parts_by_size(spark, sf, tmp_path, small_tasks):
    db = Database.create(spark, f"file://{tmp_path}/db")
    txn = graph_transactions.GraphTransaction(db)
    txn.load(T.props(spark, sf, ("nation", "part")), T.edges(spark, sf, ("IN_REGION", "CONTAINS")))
    txn.commit()
    g = graph_transactions.graph(db)
    assert g.props.rdd.getNumPartitions() > 4 and g.edges.rdd.getNumPartitions() > 4
    # a value is shuffled once, not beside its place in the order
    assert "max_by" not in g.props._jdf.queryExecution().optimizedPlan().toString()
    assert g.props.exceptAll(T.props(spark, sf, ("nation", "part"))).isEmpty() and g.edges.count() == 5942 + 25
