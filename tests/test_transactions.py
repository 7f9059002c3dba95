import pytest

from factweave.operators import algorithms, facts, graph_transactions, kv, results
from factweave.operators.graph_transactions import GraphTransaction
from factweave.operators.transactions import Database, TransactionError, _manifest_name
from factweave.sources import scratch


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}/db")


def rows(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def objects(g):
    return {r["obj_id"]: r["object"] for r in results.objects_map(g.props).collect()}


def related(g):
    return sorted(map(tuple, g.edges.collect()))


def test_of_two_writers_the_later_one_fails(db):
    one, two = db.begin(), db.begin()
    one.insert("c", "a", "1")
    two.insert("c", "b", "2")
    assert one.commit() == 1
    with pytest.raises(TransactionError, match="another writer"):
        two.commit()
    assert rows(db.collection("c").scan()) == [("a", "1")]
    again = db.begin()
    again.insert("c", "b", "2")
    assert again.commit() == 2 and rows(db.collection("c").scan()) == [("a", "1"), ("b", "2")]
    # the segment of the writer that failed is gone
    assert sum(n.startswith("segment-") for n in db.files.names()) == 2


def test_a_manifest_that_is_not_whole_is_passed_over(db):
    db.insert("c", "a", "1")
    db.files.create(_manifest_name(2), '{"last_comm')
    assert rows(Database.open(db.spark, db.root).collection("c").scan()) == [("a", "1")]
    with pytest.raises(TransactionError):
        db.insert("c", "a", "2")  # it may still be being written
    assert db.repair() and not db.repair()
    assert db.insert("c", "a", "2") == 2


def test_open_snapshots_outlive_a_compaction(db):
    db.insert("c", "a", "1")
    reader = db.begin()
    db.insert("c", "a", "2")
    db.compact()
    assert reader.get("c", "a") == "1" and db.begin().get("c", "a") == "2"
    assert db.vacuum() == 2 and db.vacuum() == 0
    assert rows(db.collection("c").scan()) == [("a", "2")] and db.insert("c", "b", "3") == 3


def test_repeated_keys_have_a_stated_winner(spark, db):
    txn = db.begin()
    txn.insert_frame("c", spark.createDataFrame([("k", "3"), ("k", "1"), ("k", "2")], "key string, value string").repartition(3))
    txn.insert_frame("d", spark.createDataFrame([("k", "3", 1), ("k", "1", 2), ("k", "2", 2)], "key string, value string, n int"), "n")
    txn.commit()
    assert rows(db.collection("c").scan()) == [("k", "3")] and rows(db.collection("d").scan()) == [("k", "2")]
    log = spark.createDataFrame([("c", "k", "a", 1, 0, False, 0), ("c", "k", "b", 1, 0, False, 1), ("c", "l", "a", 1, 0, False, 0), ("c", "l", None, 1, 0, True, 0)], kv.LOG)
    assert rows(kv.latest(log)) == [("k", "b")]


def test_commit_ids_and_size(db):
    txn = db.begin()
    txn.insert("c", "a", "1")
    assert txn.commit(7) == 7 and db.last_committed == 7
    txn = db.begin()
    txn.insert("c", "a", "2")
    with pytest.raises(TransactionError):
        txn.commit(7)
    assert rows(db.collection("c", 6).scan()) == [] and db.begin(6).get("c", "a") is None
    assert db.summary().first()["bytes_on_disk"] == db.size() > 0
    assert db.begin().commit() == 7


def test_graph_transactions(db):
    txn = GraphTransaction(db)
    a = txn.insert_object({"type": "Item", "price": 100, "at": {"lat": 1.0, "lon": 2.0}})
    b = txn.insert_object({"type": "Item", "price": 101})
    assert (a, b, txn.insert_object({"none": None})) == (1, 2, 0)
    txn.insert_relationship(a, "NEXT", b)
    txn.insert_relationship(b, "NEXT", a)
    txn.insert_relationship(b, "SELF", b)
    assert set(objects(txn.graph())) == {1, 2} and objects(graph_transactions.graph(db)) == {}
    first = txn.commit()
    for late in (txn.commit, txn.abort, txn.graph, lambda: txn.insert_object({"x": 1}), lambda: txn.delete_object(1)):
        with pytest.raises(TransactionError, match="committed or aborted"):
            late()
    txn = GraphTransaction(db)
    txn.update_object(a, {"price": 150, "type": 3})
    txn.delete_object(b)
    assert txn.insert_object({"type": "lost"}) == 3
    txn.abort()
    assert objects(graph_transactions.graph(db))[2] == {"type": "Item", "price": "101"}
    txn = GraphTransaction(db)
    txn.delete_object(b)
    c = txn.insert_object({"type": "Item"})
    txn.insert_relationship(c, "NEXT", a)
    txn.set_numeric(a, "type", 3)
    txn.remove_fact(a, "at")
    assert c == 4  # 3 was given out, and 2 is gone
    txn.commit()
    g = graph_transactions.graph(Database.open(db.spark, db.root))
    assert objects(g) == {1: {"type": "3", "price": "100"}, 4: {"type": "Item"}} and related(g) == [(4, "NEXT", 1)]
    then = graph_transactions.graph(db, first)
    assert set(objects(then)) == {1, 2} and len(related(then)) == 3
    assert GraphTransaction(db, first).graph().count_relationships("NEXT").first()["n"] == 2
    txn = GraphTransaction(db)
    txn.set_string(b, "type", "back")
    txn.insert_relationship(b, "NEXT", b)
    txn.remove_relationship(c, "NEXT", a)
    txn.commit()
    g = graph_transactions.graph(db)
    assert objects(g)[2] == {"type": "back"} and related(g) == [(2, "NEXT", 2)]


def test_graph_writers_conflict_and_a_load_moves_the_counter(spark, db):
    one, two = GraphTransaction(db), GraphTransaction(db)
    one.load(facts.rows_of(spark, {40: {"name": "x"}}))
    assert one.insert_object({"name": "y"}) == 41
    two.insert_object({"name": "z"})
    one.commit()
    with pytest.raises(TransactionError, match="another writer"):
        two.commit()
    assert set(objects(graph_transactions.graph(db))) == {40, 41}


def test_deletions_one_by_one(db):
    txn = GraphTransaction(db)
    ids = [txn.insert_object({"itemId": i, "type": "t", "title": f"n{i}", "price": 100 + i}) for i in range(10)]
    txn.commit()
    left = set(ids)
    for i in (5, 8, 1, 10, 2):
        txn = GraphTransaction(db)
        txn.delete_object(i)
        txn.commit()
        left.discard(i)
    assert set(objects(graph_transactions.graph(db))) == left


def test_one_value_of_a_field(spark):
    props = facts.update_fact(facts.rows_of(spark, {1: {"age": "thirty"}}), facts.rows_of(spark, {1: {"age": 30}}))
    assert [(r["vtype"], r["nval"]) for r in props.collect()] == [("numeric", 30)]
    both = facts.rows_of(spark, {1: {"age": "thirty"}}).unionByName(facts.rows_of(spark, {1: {"age": 30, "b": 1}}))
    assert results.objects_map(both).first()["object"] == {"age": "thirty", "b": "1"}


def test_hubs(spark):
    """A hub of 100,000 relationships: few steps of two are met, and the counts are right."""
    n = 100_000
    spokes = spark.range(1, n + 1).selectExpr("CAST(0 AS BIGINT) AS src", "'K' AS rel", "id AS dst")
    rim = spark.range(1, n).selectExpr("id AS src", "'K' AS rel", "id + 1 AS dst").where("src % 2 = 1")
    edges = spokes.unionByName(rim)
    assert algorithms.triangles_undirected(edges, "K").first()["triangles"] == n // 2
    assert algorithms.transitive_triples(edges, "K").first()["n"] == n // 2
    path = algorithms.shortest_path(edges, 3, 4, "K").orderBy("pos").collect()
    assert [r["obj_id"] for r in path] == [3, 4] and algorithms.shortest_path(edges, 2, 1, "K").count() == 0


def test_objects_related_to_themselves(spark):
    pairs = [(1, 1), (1, 2), (2, 1), (2, 3), (1, 3), (3, 3)]
    edges = facts.edge_rows(spark, [(a, "K", b) for a, b in pairs])
    triples = sum((u, v) in pairs and (v, w) in pairs and (u, w) in pairs for u in range(4) for v in range(4) for w in range(4))
    assert algorithms.transitive_triples(edges, "K").first()["n"] == triples


def test_laid_down_in_several_files(spark, tmp_path):
    from factweave.operators.graph import Graph

    g = Graph(facts.rows_of(spark, {i: {"type": "t"} for i in range(500)}).repartition(3), facts.edge_rows(spark, [(i, "K", i + 1) for i in range(500)]).repartition(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    g.write(f"{tmp_path}/g")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g/props/field=type").glob("*.parquet"))) > 1
    assert Graph.read(spark, f"{tmp_path}/g").props.count() == 500


def test_pages_by_key(spark):
    df = spark.range(25).selectExpr("id AS key")
    assert [r["key"] for r in results.page_after(df, "key", 9, 5).collect()] == [10, 11, 12, 13, 14]
    assert [tuple(results.page_totals(df, n, 10).first()) for n in (1, 3, 4)] == [(25, 3, 1, 10), (25, 3, 3, 5), (25, 3, 4, 0)]
    assert tuple(results.page_totals(df.limit(0)).first()) == (0, 0, 1, 0)


def test_scratch_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(Session, "conf", type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
