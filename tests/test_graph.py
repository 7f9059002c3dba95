import random
from itertools import product

import pytest

from factweave.operators import algorithms, facts, sets
from factweave.operators.graph import Graph
from factweave.operators.results import objects_map
from factweave.plans.builder import Query
from factweave.sources.tables import EDGES, PROPS

PEOPLE = {
    101: ("User_101", "dev", "London", "active", 25),
    102: ("User_102", "dev", "Paris", "active", 35),
    103: ("User_103", "dev", "London", "inactive", 45),
    201: ("User_201", "manager", "Paris", "active", 40),
    202: ("User_202", "manager", "London", "active", 50),
    301: ("User_301", "designer", "Tokyo", "active", 30),
    302: ("User_302", "designer", "Paris", "inactive", 28),
}


@pytest.fixture(scope="module")
def graph(spark):
    objects = {i: dict(zip(("type", "name", "role", "city", "status", "age"), ("user", *p))) for i, p in PEOPLE.items()}
    objects |= {901: {"type": "project", "name": "one", "status": "active"}, 902: {"type": "project", "name": "two", "status": "active"}}
    edges = [(101, "WORKS_ON", 901), (102, "WORKS_ON", 901), (201, "MANAGES", 901), (202, "MANAGES", 902), (301, "WORKS_ON", 902), (101, "REPORTS_TO", 201), (102, "REPORTS_TO", 201), (301, "REPORTS_TO", 202)]
    return Graph(facts.rows_of(spark, objects).cache(), facts.edge_rows(spark, edges).cache())


def ids(df):
    return sorted(r["obj_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("build", "expected"),
    [
        (lambda q: q.find({"city": "London", "role": "dev"}).traverse("out", "REPORTS_TO"), [201]),
        (lambda q: q.find({"role": "manager", "status": "active"}).filter({"city": "Paris"}), [201]),
        (lambda q: q.find([{"role": "designer", "city": "Tokyo"}, {"status": "inactive"}]), [103, 301, 302]),
        (lambda q: q.find({"role": "dev", "city": "London"}).traverse("out", "REPORTS_TO", {"city": "Paris"}), [201]),
        (lambda q: q.find({"type": "user", "age": {"gte": 30, "lte": 40}}), [102, 201, 301]),
        (lambda q: q.find({"age": {"gt": 30, "lt": 40}}), [102]),
        (lambda q: q.find({"age": 30}), [301]),
        (lambda q: q.find({"name": "one"}).traverse("in", "WORKS_ON"), [101, 102]),
        (lambda q: q.find({"role": "manager"}).union({"city": "Tokyo", "age": 25}), [101, 201, 202, 301]),
        (lambda q: q.find({"city": "Nowhere"}).traverse("out", "REPORTS_TO"), []),
        (lambda q: q.find({"role": "dev"}).traverse("out", "REPORTS_TO", {}), [201]),
    ],
)
def test_plans(graph, build, expected):
    assert ids(build(Query(graph)).ids()) == expected


def test_plan_errors(graph):
    q = Query(graph)
    for bad in (lambda: q.ids(), lambda: q.filter({"a": 1}).ids(), lambda: q.find({"a": None}), lambda: q.traverse("up", "X"), lambda: q.find({"a": []}).ids(), lambda: q.find({"a": {"odd": 1}}).ids()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        q.find("x")


def test_readers(graph):
    assert {(r["field"], r["value"]) for r in graph.facts(101).collect()} >= {("name", "User_101"), ("age", "25"), ("REPORTS_TO", "201")}
    assert graph.string(101, "city").first()["value"] == "London" and graph.string(101, "age").first() is None
    assert graph.numeric(101, "age").first()["value"] == 25
    assert {r["rel"] for r in graph.relationship_types().collect()} == {"WORKS_ON", "MANAGES", "REPORTS_TO"}
    assert graph.count_by_property("city", "Paris").first()["n"] == 3
    assert graph.count_relationships("WORKS_ON").first()["n"] == 3
    assert ids(graph.outgoing(101, "WORKS_ON")) == [901] and ids(graph.incoming(201, "REPORTS_TO")) == [101, 102]
    assert graph.has_relationship(101, "REPORTS_TO", 201) and not graph.has_relationship(201, "REPORTS_TO", 101)
    assert ids(graph.common_neighbours(101, 102, "REPORTS_TO")) == [201]
    assert ids(graph.without("age")) == [901, 902]
    assert ids(graph.by_range("age", 25, 30)) == [101, 301, 302] and ids(graph.by_range("age", high=28)) == [101, 302]


def test_directions_are_dual(spark, graph):
    for rel in ("WORKS_ON", "REPORTS_TO"):
        for r in graph.edges.where(f"rel = '{rel}'").collect():
            assert r["dst"] in ids(graph.outgoing(r["src"], rel)) and r["src"] in ids(graph.incoming(r["dst"], rel))


def test_pages(spark, graph):
    found = Query(graph).find({"type": "user"}).union({"type": "project"}).execute()
    assert found.total_count() == 9
    seen = [r["obj_id"] for n in (1, 2, 3) for r in found.page(n, 4).collect()]
    assert seen == sorted(seen) and len(seen) == 9
    assert found.page(4, 4).count() == 0
    assert [o["id"] for o in found] == seen
    ghosts = Graph(graph.props, graph.edges.unionByName(facts.edge_rows(spark, [(101, "KNOWS", 555)])))
    assert Query(ghosts).find({"name": "User_101"}).traverse("out", "KNOWS").execute().total_count() == 0
    wide = Query(graph).find({"city": "Tokyo"}).execute().wide(["name", "age", "none"]).first()
    assert (wide["name"], wide["age"], wide["none"]) == ("User_301", "30", None)


def test_writes(spark):
    props, made = facts.insert_objects(spark.createDataFrame([], PROPS), [{"type": "Widget", "price": 100, "color": "blue"}, {"none": None}, {"ok": True, "n": 1.9}])
    assert made == [1, 0, 2]
    props = facts.update_objects(props, facts.rows_of(spark, {1: {"price": 150, "status": "new"}}))
    g = Graph(props, spark.createDataFrame([], EDGES))
    assert ids(g.by_property("price", 100)) == [] and ids(g.by_property("color", "blue")) == [] and ids(g.by_property("price", 150)) == [1]
    assert {r["field"]: r["nval"] for r in props.where("obj_id = 2").collect()} == {"ok": 1, "n": 1}
    props = facts.update_fact(props, facts.rows_of(spark, {1: {"status": "old"}}))
    assert objects_map(props).where("obj_id = 1").first()["object"] == {"price": "150", "status": "old"}
    edges = facts.insert_edges(spark.createDataFrame([], EDGES), facts.edge_rows(spark, [(1, "A", 2), (1, "A", 2), (2, "A", 1), (2, "B", 2)]))
    assert edges.count() == 3
    assert facts.remove_edges(edges, facts.edge_rows(spark, [(1, "A", 2)])).count() == 2
    left, kept = facts.delete_objects(props, edges, spark.createDataFrame([(1,)], "obj_id long"))
    assert left.where("obj_id = 1").count() == 0 and [(r["src"], r["rel"], r["dst"]) for r in kept.collect()] == [(2, "B", 2)]
    assert facts.remove_props(props, props["field"] == "status").where("field = 'status'").count() == 0


def test_places(spark):
    at = {1: (37.422, -122.084), 2: (37.334, -122.009), 3: (37.755, -122.452)}
    g = Graph(facts.rows_of(spark, {i: {"place": {"lat": a, "lon": b}} for i, (a, b) in at.items()}), spark.createDataFrame([], EDGES))
    assert ids(Query(g).find({"place": {"lat": 37.422, "lon": -122.084}}).ids()) == [1]
    near = {"near": {"lat": 37.4, "lon": -122.0}, "radius": 10_000}
    assert ids(Query(g).find({"place": near}).ids()) == [1, 2] == ids(g.near("place", 37.4, -122.0, 10_000))
    assert ids(Query(g).find({"place": near | {"mode": "radius"}}).ids()) == [1, 2]
    assert ids(g.near("place", 37.334, -122.009, 10, "radius")) == [2]
    assert g.numeric(1, "place").first()["value"] == 5589826863130677144


def test_partitioned_layout(spark, graph, tmp_path):
    graph.write(f"{tmp_path}/g")
    again = Graph.read(spark, f"{tmp_path}/g")
    assert ids(again.by_property("city", "London")) == ids(graph.by_property("city", "London"))
    assert ids(again.hop(again.by_property("role", "dev"), "out", "REPORTS_TO")) == [201]
    plan = again.by_property("city", "London")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan


def brute_path(edges, start, end):
    level, seen = {start: [start]}, {start}
    while level:
        if end in level:
            return level[end]
        new = {}
        for node, path in level.items():
            for a, b in edges:
                if a == node and b not in seen:
                    new[b] = min(new.get(b, path + [b]), path + [b])
        seen |= set(new)
        level = new
    return []


def test_algorithms_against_brute_force(spark):
    rng = random.Random(3)
    pairs = {(rng.randint(1, 14), rng.randint(1, 14)) for _ in range(40)}
    pairs = {(a, b) for a, b in pairs if a != b}
    edges = facts.edge_rows(spark, [(a, "K", b) for a, b in sorted(pairs)] + [(1, "OTHER", 9)]).cache()
    for start, end in ((1, 9), (2, 14), (5, 5), (3, 99)):
        found = [r["obj_id"] for r in algorithms.shortest_path(edges, start, end, "K").orderBy("pos").collect()]
        assert found == brute_path(pairs, start, end)
    triples = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a, b, c in product(range(15), repeat=3))
    assert algorithms.triangles(edges, "K").first()["triangles"] == triples // 3
    both = {frozenset(p) for p in pairs}
    closed = {frozenset((a, b, c)) for a, b, c in product(range(1, 15), repeat=3) if len({a, b, c}) == 3 and {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= both}
    assert algorithms.triangles_undirected(edges, "K").first()["triangles"] == len(closed)
    g = Graph(spark.createDataFrame([], PROPS), edges)
    assert {(r["a"], r["b"]) for r in g.mutual("K").collect()} == {(a, b) for a, b in pairs if a < b and (b, a) in pairs}


def test_shortest_paths_are_as_long_as_they_have_to_be(spark):
    edges = facts.edge_rows(spark, [(k, "K", k + 1) for k in range(1, 68)] + [(68, "K", 1)]).cache()
    assert [r["obj_id"] for r in algorithms.shortest_path(edges, 1, 68, "K").orderBy("pos").collect()] == list(range(1, 69))
    with pytest.raises(ValueError):
        algorithms.shortest_path(edges, 1, 9, "K", most=3)


def test_few_sources_have_no_triangles(spark):
    edges = facts.edge_rows(spark, [(1, "K", 2), (1, "K", 3), (2, "K", 3)])
    assert algorithms.triangles(edges, "K").first()["triangles"] == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "obj_id long") for v in ([0, 1, 5, 40_000], [1, 40_000, 70_000]))
    assert ids(sets.intersect(a, b)) == [1, 40_000]
    assert ids(sets.union(a, b)) == [0, 1, 5, 40_000, 70_000]
    assert ids(sets.and_not(a, b)) == [0, 5]
    assert sets.cardinality(a) == 4 and not sets.is_empty(a)
    assert ids(sets.from_bitmaps(sets.bitmaps(a))) == [0, 1, 5, 40_000]
