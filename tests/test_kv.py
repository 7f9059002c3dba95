import random

import pytest

from factweave.operators import kv, results
from factweave.operators.transactions import Database, TransactionError
from factweave.streaming import current


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}/db")


def rows(df):
    return [(r["key"], r["value"]) for r in df.collect()]


def test_single_operations(db):
    db.insert("users", "user:1", "Alice")
    db.insert("users", "user:empty", "")
    db.insert("users", "user:large", "a" * 102_400)
    users = db.collection("users")
    assert rows(users.get("user:1")) == [("user:1", "Alice")]
    assert rows(users.get("user:empty")) == [("user:empty", "")]
    assert len(rows(users.get("user:large"))[0][1]) == 102_400
    db.remove("users", "user:1")
    assert rows(db.collection("users").get("user:1")) == []
    assert rows(users.get("user:1")) == [("user:1", "Alice")]  # a fixed snapshot
    assert rows(db.collection("orders").get("user:empty")) == []


def test_mixed_batch_and_order(db):
    txn = db.begin()
    txn.execute_batch("c", [("insert", "batch:1", "A"), ("insert", "batch:2", "B"), ("insert", "batch:3", "C"), ("remove", "batch:2"), ("insert", "batch:1", "Z")])
    txn.commit()
    found = db.collection("c").multi_get(["batch:3", "batch:2", "batch:1"]).orderBy("pos").collect()
    assert [r["value"] for r in found] == ["C", None, "Z"]


def test_paging(db):
    db.insert_batch("p", [(f"page_user:{i:02}", f"User number {i}") for i in range(25)])
    found = db.collection("p").range("page_user:", "page_user:~")
    assert found.count() == 25
    pages = [[r["key"][-2:] for r in results.page(found, "key", n, 10).collect()] for n in (1, 2, 3, 4)]
    assert (pages[0][0], pages[0][-1], len(pages[2]), pages[2][-1], pages[3]) == ("00", "09", 5, "24", [])
    assert sum(pages, []) == [f"{i:02}" for i in range(25)]
    with pytest.raises(ValueError):
        results.page(found, "key", 0)


def test_range_ends_and_prefix(db):
    db.insert_batch("r", [(k, k) for k in ("a", "ab", "b", "c", "~", "é")])
    c = db.collection("r")
    assert [k for k, _ in rows(c.range("ab", "c"))] == ["ab", "b"]
    assert [k for k, _ in rows(c.range(None, ""))] == ["a", "ab", "b", "c", "~", "é"]
    assert [k for k, _ in rows(c.prefix("a"))] == ["a", "ab"]
    assert c.count() == 6 and list(c.cursor("b")) == [(k, k) for k in ("b", "c", "~", "é")]


def test_transactions(db):
    db.insert_batch("acct", [("acct:1", "1000"), ("acct:2", "500")])
    txn = db.begin()
    txn.insert("acct", "acct:1", "900")
    txn.insert("acct", "acct:2", "600")
    assert txn.get("acct", "acct:1") == "900"
    assert rows(db.collection("acct").get("acct:1")) == [("acct:1", "1000")]
    txn.commit()
    txn = db.begin()
    txn.insert("acct", "acct:1", "0")
    txn.remove("acct", "acct:2")
    txn.abort()
    assert rows(db.collection("acct").scan()) == [("acct:1", "900"), ("acct:2", "600")]
    with pytest.raises(TransactionError, match="committed or aborted"):
        txn.insert("acct", "acct:1", "1")


def test_reopen_compact_and_drop(spark, db):
    db.insert("u", "user:1", "kris")
    db.insert("o", "order:1", "product")
    db.insert("u", "user:1", "kris_updated")
    db.insert("u", "user:2", "gone")
    db.remove("u", "user:2")
    again = Database.open(spark, db.root)
    before = sorted(rows(kv.latest(again.log())))
    again.compact()
    assert sorted(rows(kv.latest(again.log()))) == before == [("order:1", "product"), ("user:1", "kris_updated")]
    assert again.log().count() == 2 and again.generation == 1
    assert again.insert("u", "user:3", "x") == 6
    again.close()
    with pytest.raises(RuntimeError, match="closed"):
        again.collection("u")
    assert Database.drop(spark, db.root)
    assert not Database.drop(spark, db.root)
    with pytest.raises(FileNotFoundError):
        Database.open(spark, db.root)


def test_statistics(spark):
    log = spark.createDataFrame([("c", "k1", "vv", 1, 0, False, 0), ("c", "k1", "v", 2, 0, False, 0), ("c", "zz", None, 3, 0, True, 1), ("c", "k2", "", 4, 0, False, 1), ("c", "k2", None, 5, 0, True, 1)], kv.LOG)
    row = kv.statistics(log).first()
    assert (row["logical_item_count"], row["live_record_bytes"], row["live_keys"], row["generations"]) == (1, 28 + 27 + 26, 1, 2)
    assert kv.database_summary(log).first()["collections"] == 1


def test_against_a_model(spark):
    """Random writes of transactions, read at every kind of snapshot, against dictionaries."""
    rng = random.Random(7)
    log, states, state = [], [{}], {}
    for txn in range(1, 41):
        for seq in range(rng.randint(1, 6)):
            key = f"k{rng.randint(0, 15)}"
            if rng.random() < 0.3:
                log.append(("c", key, None, txn, seq, True, rng.randint(0, 1)))
                state.pop(key, None)
            else:
                value = f"v{txn}.{seq}"
                log.append(("c", key, value, txn, seq, False, rng.randint(0, 1)))
                state[key] = value
        states.append(dict(state))
    rng.shuffle(log)
    df = spark.createDataFrame(log, kv.LOG).cache()
    for snapshot in (0, 1, 13, 40):
        assert dict(rows(kv.latest(df, snapshot))) == states[snapshot]
    compacted = kv.compact(df, 2)
    assert dict(rows(kv.latest(compacted))) == states[-1]
    assert kv.latest(spark.createDataFrame([], kv.LOG)).count() == 0


def test_stream(spark, tmp_path):
    path, out, seen = (f"file://{tmp_path}/{x}" for x in ("log", "out", "seen"))
    spark.createDataFrame([("c", "a", "1", 1, 0, False, 0), ("c", "b", "1", 1, 1, False, 0)], kv.LOG).write.parquet(path + "/1")
    current.maintain(current.log_stream(spark, path), out, seen).awaitTermination(60)
    assert sorted(rows(current.current(spark, out))) == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("c", "a", "2", 2, 0, False, 0), ("c", "b", None, 3, 0, True, 0)], kv.LOG).write.parquet(path + "/2")
    current.maintain(current.log_stream(spark, path), out, seen).awaitTermination(60)
    assert rows(current.current(spark, out)) == [("a", "2")]
