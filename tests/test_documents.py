import pytest

from factweave.operators.documents import DocQuery, Op, index_entries


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("user", i, {"name": f"n{i}", "age": str(20 + i), "city": ("London", "Paris")[i % 2]}) for i in range(10)]
    return spark.createDataFrame([*rows, ("other", 1, {"name": "n1", "age": "21"}), ("user", 11, {"age": "old"})], "ns string, id long, doc map<string,string>")


def ids(query):
    return [r["id"] for r in query.execute().orderBy("id").collect()]


def test_operators(docs):
    q = DocQuery(docs, "user")
    assert ids(q.where("age", Op.EQ, 23)) == [3]
    assert ids(q.where("age", Op.GT, 27)) == [8, 9] and ids(q.where("age", Op.GTE, 28)) == [8, 9]
    assert ids(q.where("age", Op.LT, 22)) == [0, 1] and ids(q.where("age", Op.LTE, 21)) == [0, 1]
    assert ids(q.where("age", Op.BETWEEN, 22, 24)) == [2, 3, 4]
    assert ids(q.where_string("name", Op.PREFIX, "n1")) == [1]
    assert ids(q.where_string("city", Op.EQ, "Paris").where("age", Op.GT, 24)) == [5, 7, 9]
    assert ids(q) == []
    with pytest.raises(ValueError):
        q.where("age", Op.PREFIX, 1)
    with pytest.raises(ValueError):
        q.where("age", Op.BETWEEN, 1)


def test_limit_and_projection(docs):
    found = DocQuery(docs, "user").where_string("city", Op.EQ, "London").select("name", "none").limit(2).execute()
    assert found.columns == ["id", "name", "none"]
    assert [tuple(r) for r in found.collect()] == [(0, "n0", None), (2, "n2", None)]


def test_index_entries(docs):
    assert index_entries(docs, "city").where("id = 0").first()["key"] == "idx_str:user:city:London:0"
