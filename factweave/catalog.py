"""Registry of the queries over versioned key/value, document and graph data, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import algorithms, documents, facts, graph_transactions, kv, results, sets
from factweave.operators.documents import DocQuery, Op
from factweave.operators.graph import Graph, value_text
from factweave.operators.transactions import Database
from factweave.plans.builder import Query
from factweave.sources import scratch, sizes
from factweave.sources import tables as T
from factweave.streaming import current

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Run], Run]:
    def register(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# the derived graph, as SQL
def _props_sql() -> str:
    numbers = {"customer": {"acctbal_cents": "c_acctbal"}, "supplier": {"acctbal_cents": "s_acctbal"}, "part": {"size": "p_size", "retail_cents": "p_retailprice"}, "nation": {}, "region": {}, "order": {"total_cents": "o_totalprice"}}
    out = []
    for kind, (name, key, strings, _) in T.OBJECTS.items():
        object_id = f"{T.CODES[kind] * 10**9 + 1} + {key} AS obj_id"
        out.append(f"SELECT {object_id}, 'type' AS field, 'string' AS vtype, '{kind}' AS sval, CAST(NULL AS BIGINT) AS nval FROM {name}")
        out += [f"SELECT {object_id}, '{f}', 'string', {c}, NULL FROM {name} WHERE {c} IS NOT NULL" for f, c in strings.items()]
        out += [f"SELECT {object_id}, '{f}', 'numeric', NULL, CAST({c if f == 'size' else f'round({c} * 100)'} AS BIGINT) FROM {name} WHERE {c} IS NOT NULL" for f, c in numbers[kind].items()]
    return "props AS (" + " UNION ALL ".join(out) + ")"


_C, _S, _P, _N, _R, _O = (T.CODES[k] * 10**9 + 1 for k in ("customer", "supplier", "part", "nation", "region", "order"))
PROPS = _props_sql()
EDGES = f"""knows AS (
  SELECT c_custkey AS c, unnest([(c_custkey + 1) % n, (c_custkey + 2) % n, (c_custkey + 7) % n, (c_custkey * 7 + 1) % n, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey + n - 1) % n END]) AS d
  FROM customer, (SELECT count(*) AS n FROM customer)
), edges AS (
  SELECT {_C} + c_custkey AS src, 'IN_NATION' AS rel, {_N} + c_nationkey AS dst FROM customer
  UNION SELECT {_S} + s_suppkey, 'IN_NATION', {_N} + s_nationkey FROM supplier
  UNION SELECT {_N} + n_nationkey, 'IN_REGION', {_R} + n_regionkey FROM nation
  UNION SELECT {_C} + o_custkey, 'PLACED', {_O} + o_orderkey FROM orders
  UNION SELECT {_O} + l_orderkey, 'CONTAINS', {_P} + l_partkey FROM lineitem
  UNION SELECT {_S} + l_suppkey, 'SUPPLIES', {_P} + l_partkey FROM lineitem
  UNION SELECT {_C} + c, 'KNOWS', {_C} + d FROM knows WHERE d IS NOT NULL AND c <> d
)"""
LOG = "log AS (SELECT 'user:' || user_id AS key, CASE WHEN event_type <> 'error' THEN event_type END AS value, event_id AS txn_id, event_type = 'error' AS is_deleted, event_id % 2 AS generation FROM events)"
ORDER_KV = "kv AS (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderstatus AS value FROM orders)"


def _latest_sql(where: str = "TRUE") -> str:
    return f"latest AS (SELECT key, arg_max(value, txn_id) FILTER (TRUE) AS ignored, arg_max({{'value': value, 'is_deleted': is_deleted}}, txn_id) AS v, max(txn_id) AS txn_id FROM log WHERE {where} GROUP BY key)"


def graph(spark: SparkSession, sf_dir: str, rels: tuple[str, ...] = (), kinds: tuple[str, ...] = tuple(T.OBJECTS)) -> Graph:
    """The derived graph with the relationships that a query names; all facts are lazy branches."""
    return Graph(lambda: T.props(spark, sf_dir, kinds), lambda: T.edges(spark, sf_dir, rels) if rels else spark.createDataFrame([], T.EDGES), lambda: T.props_by_object(spark, sf_dir, kinds))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the nations of customers in one market segment, as objects."""
    g = graph(spark, sf_dir, ("IN_NATION", "IN_REGION"))
    found = Query(g).find({"type": "customer", "mktsegment": "BUILDING"}).traverse("out", "IN_NATION").traverse("out", "IN_REGION").execute()
    return found.wide(["type", "name"])


# key/value collections
def _orders(spark: SparkSession, sf_dir: str) -> kv.Collection:
    return kv.Collection(T.order_log(spark, sf_dir), "orders")


@query("kv_get", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE key = 'order:0000000042'")
def kv_get(spark, d):
    return _orders(spark, d).get("order:0000000042")


KEYS = ["order:0000000007", "order:0000000003", "order:9999999999", "order:0000000003", "order:0000000001"]


@query("kv_multi_get", f"WITH {ORDER_KV}, asked AS (SELECT unnest({KEYS}) AS key, unnest(range({len(KEYS)})) AS pos) SELECT pos, asked.key AS key, value FROM asked LEFT JOIN kv USING (key)")
def kv_multi_get(spark, d):
    return _orders(spark, d).multi_get(KEYS)


@query("kv_range", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE key >= 'order:0000000100' AND key < 'order:0000000200'")
def kv_range(spark, d):
    return _orders(spark, d).range("order:0000000100", "order:0000000200")


@query("kv_scan", f"WITH {ORDER_KV} SELECT key, value FROM kv")
def kv_scan(spark, d):
    return _orders(spark, d).scan()


@query("kv_prefix", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE starts_with(key, 'order:00000003')")
def kv_prefix(spark, d):
    return _orders(spark, d).prefix("order:00000003")


@query("kv_page", f"WITH {ORDER_KV} SELECT key, value FROM kv ORDER BY key LIMIT 25 OFFSET 50")
def kv_page(spark, d):
    return results.page(_orders(spark, d).current(), "key", 3, 25)


@query("kv_total_count", f"WITH {ORDER_KV} SELECT count(*) AS n FROM kv WHERE key >= 'order:0000000100'")
def kv_total_count(spark, d):
    return _orders(spark, d).range("order:0000000100").agg(F.count(F.lit(1)).alias("n"))


@query("kv_snapshot_latest", f"WITH {LOG}, {_latest_sql()} SELECT key, v.value AS value, txn_id FROM latest WHERE NOT v.is_deleted")
def kv_snapshot_latest(spark, d):
    return kv.latest(T.user_log(spark, d)).select("key", "value", "txn_id")


@query("kv_snapshot_asof", f"WITH {LOG}, {_latest_sql('txn_id <= 500')} SELECT key, v.value AS value, txn_id FROM latest WHERE NOT v.is_deleted")
def kv_snapshot_asof(spark, d):
    return kv.latest(T.user_log(spark, d), 500).select("key", "value", "txn_id")


@query(
    "kv_batch_last_wins",
    """WITH ops AS (SELECT 'event:' || event_type AS key, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS value, event_id AS seq, event_id % 7 = 0 AS is_deleted FROM events),
    last AS (SELECT key, arg_max({'value': value, 'is_deleted': is_deleted}, seq) AS v FROM ops GROUP BY key) SELECT key, v.value AS value FROM last WHERE NOT v.is_deleted""",
)
def kv_batch_last_wins(spark, d):
    gone = F.col("event_id") % 7 == 0
    batch = T.table(spark, d, "events").select(F.lit("batch").alias("collection"), F.concat(F.lit("event:"), "event_type").alias("key"), F.when(~gone, F.col("user_id").cast("string")).alias("value"), F.lit(1).cast("long").alias("txn_id"), F.col("event_id").alias("seq"), gone.alias("is_deleted"), F.lit(0).alias("generation"))
    return kv.latest(batch).select("key", "value")


@query("kv_compact", f"WITH {LOG}, {_latest_sql()} SELECT key, v.value AS value, txn_id, 1 AS generation FROM latest WHERE NOT v.is_deleted")
def kv_compact(spark, d):
    return kv.compact(T.user_log(spark, d), 1).select("key", "value", "txn_id", "generation")


@query("kv_generation_merge", f"WITH {LOG}, {_latest_sql()} SELECT key, v.value AS value FROM latest WHERE NOT v.is_deleted AND key >= 'user:1' AND key < 'user:2'")
def kv_generation_merge(spark, d):
    log = T.user_log(spark, d)
    merged = kv.merge_generations(log.where("generation = 0"), log.where("generation = 1"))
    return kv.Collection(merged, "users").range("user:1", "user:2")


@query(
    "kv_stats",
    f"""WITH {LOG}, {_latest_sql()} SELECT 'users' AS collection, CAST(sum(CASE WHEN is_deleted THEN -1 ELSE 1 END) AS BIGINT) AS logical_item_count,
    CAST(sum(CASE WHEN NOT is_deleted THEN strlen(key) + strlen(coalesce(value, '')) + 24 END) AS BIGINT) AS live_record_bytes,
    (SELECT count(*) FROM latest WHERE NOT v.is_deleted) AS live_keys, count(DISTINCT generation) AS generations FROM log""",
)
def kv_stats(spark, d):
    return kv.statistics(T.user_log(spark, d))


@query(
    "kv_db_summary",
    f"""WITH {LOG}, {_latest_sql()} SELECT CAST(sum(CASE WHEN is_deleted THEN -1 ELSE 1 END) AS BIGINT) + (SELECT count(*) FROM orders) AS logical_item_count,
    CAST(sum(CASE WHEN NOT is_deleted THEN strlen(key) + strlen(coalesce(value, '')) + 24 END) AS BIGINT) + (SELECT CAST(sum(16 + strlen(o_orderstatus) + 24) AS BIGINT) FROM orders) AS live_record_bytes,
    (SELECT count(*) FROM latest WHERE NOT v.is_deleted) + (SELECT count(*) FROM orders) AS live_keys, CAST(2 AS BIGINT) AS generations, CAST(2 AS BIGINT) AS collections FROM log""",
)
def kv_db_summary(spark, d):
    return kv.database_summary(kv.merge_generations(T.user_log(spark, d), T.order_log(spark, d)))


# text documents
DOCS = "docs AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part)"


def _docs(spark: SparkSession, d: str) -> DocQuery:
    return DocQuery(T.part_docs(spark, d), "part")


@query("doc_eq", f"WITH {DOCS} SELECT id, name FROM docs WHERE brand = 'Brand#1'")
def doc_eq(spark, d):
    return _docs(spark, d).where_string("brand", Op.EQ, "Brand#1").select("name").execute()


@query("doc_and", f"WITH {DOCS} SELECT id, brand, CAST(size AS VARCHAR) AS size FROM docs WHERE brand >= 'Brand#1' AND size = 10")
def doc_and(spark, d):
    return _docs(spark, d).where_string("brand", Op.GTE, "Brand#1").where("size", Op.EQ, 10).select("brand", "size").execute()


@query("doc_between", f"WITH {DOCS} SELECT id, CAST(size AS VARCHAR) AS size FROM docs WHERE size BETWEEN 10 AND 15")
def doc_between(spark, d):
    return _docs(spark, d).where("size", Op.BETWEEN, 10, 15).select("size").execute()


@query("doc_prefix", f"WITH {DOCS} SELECT id, type FROM docs WHERE starts_with(type, 'S')")
def doc_prefix(spark, d):
    return _docs(spark, d).where_string("type", Op.PREFIX, "S").select("type").execute()


@query("doc_cmp", f"WITH {DOCS} SELECT id, CAST(size AS VARCHAR) AS size FROM docs WHERE size > 5 AND size < 45 AND size >= 7 AND size <= 40")
def doc_cmp(spark, d):
    return _docs(spark, d).where("size", Op.GT, 5).where("size", Op.LT, 45).where("size", Op.GTE, 7).where("size", Op.LTE, 40).select("size").execute()


@query("doc_limit", f"WITH {DOCS} SELECT id, name FROM docs WHERE size > 20 ORDER BY id LIMIT 10")
def doc_limit(spark, d):
    return _docs(spark, d).where("size", Op.GT, 20).select("name").limit(10).execute()


@query("doc_project", f"WITH {DOCS} SELECT id, type, brand FROM docs WHERE size < 3")
def doc_project(spark, d):
    return _docs(spark, d).where("size", Op.LT, 3).select("type", "brand").execute()


@query("doc_no_condition", f"WITH {DOCS} SELECT id, name FROM docs WHERE FALSE")
def doc_no_condition(spark, d):
    return _docs(spark, d).select("name").execute()


@query("doc_parse", "SELECT p_partkey AS id, p_name AS name, p_brand || ':' || p_type AS tag, CAST(NULL AS VARCHAR) AS none FROM part")
def doc_parse(spark, d):
    doc = S.doc_text(id=F.col("p_partkey"), name=F.col("p_name"), tag=F.concat("p_brand", F.lit(":"), "p_type"), size=F.col("p_size"))
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), doc.alias("doc"))
    return rows.select("id", S.doc_field("doc", "name").alias("name"), S.doc_field("doc", "tag").alias("tag"), S.doc_field("doc", "none").alias("none"))


@query("doc_index", "SELECT 'idx_str:part:brand:' || p_brand || ':' || p_partkey AS key, p_partkey AS id FROM part")
def doc_index(spark, d):
    return documents.index_entries(T.part_docs(spark, d), "brand")


@query("doc_map", "SELECT p_partkey AS id, unnest(['name', 'tag']) AS field, unnest([p_name, p_brand || ':' || p_type]) AS value FROM part")
def doc_map(spark, d):
    doc = S.doc_text(name=F.col("p_name"), tag=F.concat("p_brand", F.lit(":"), "p_type"))
    twice = F.concat(doc, F.lit("|name:other|odd"))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(S.doc_map(twice)).alias("field", "value"))


# graph readers
@query("g_object_facts", f"WITH {PROPS}, {EDGES} SELECT obj_id, field, coalesce(sval, CAST(nval AS VARCHAR)) AS value FROM props WHERE obj_id = {_C + 3} UNION ALL SELECT src, rel, CAST(dst AS VARCHAR) FROM edges WHERE src = {_C + 3}")
def g_object_facts(spark, d):
    return graph(spark, d, ("IN_NATION", "PLACED", "KNOWS")).facts(_C + 3)


@query("g_prop_string", f"WITH {PROPS} SELECT obj_id, sval AS value FROM props WHERE obj_id = {_P + 5} AND field = 'brand' AND vtype = 'string'")
def g_prop_string(spark, d):
    return graph(spark, d).string(_P + 5, "brand")


@query("g_prop_numeric", f"WITH {PROPS} SELECT obj_id, nval AS value FROM props WHERE obj_id = {_P + 5} AND field = 'size' AND vtype = 'numeric'")
def g_prop_numeric(spark, d):
    return graph(spark, d).numeric(_P + 5, "size")


@query("g_rel_types", f"WITH {EDGES} SELECT DISTINCT rel FROM edges")
def g_rel_types(spark, d):
    return Graph(spark.createDataFrame([], T.PROPS), T.edges(spark, d)).relationship_types()


@query("g_by_property", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'BUILDING'")
def g_by_property(spark, d):
    return graph(spark, d).by_property("mktsegment", "BUILDING")


@query("g_by_range", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE field = 'acctbal_cents' AND nval BETWEEN 0 AND 250000")
def g_by_range(spark, d):
    return graph(spark, d).by_range("acctbal_cents", 0, 250_000)


@query("g_count_by_property", f"WITH {PROPS} SELECT count(DISTINCT obj_id) AS n FROM props WHERE field = 'status' AND sval = 'F'")
def g_count_by_property(spark, d):
    return graph(spark, d).count_by_property("status", "F")


@query("g_without_field", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE obj_id NOT IN (SELECT obj_id FROM props WHERE field = 'name')")
def g_without_field(spark, d):
    return graph(spark, d).without("name")


@query("g_count_rel", f"WITH {EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def g_count_rel(spark, d):
    return Graph(spark.createDataFrame([], T.PROPS), T.edges(spark, d)).count_relationships()


@query("g_out", f"WITH {EDGES} SELECT DISTINCT dst AS obj_id FROM edges WHERE src = {_C + 7} AND rel = 'KNOWS'")
def g_out(spark, d):
    return graph(spark, d, ("KNOWS",)).outgoing(_C + 7, "KNOWS")


@query("g_in", f"WITH {EDGES} SELECT DISTINCT src AS obj_id FROM edges WHERE dst = {_N + 3} AND rel = 'IN_NATION'")
def g_in(spark, d):
    return graph(spark, d, ("IN_NATION",)).incoming(_N + 3, "IN_NATION")


@query("g_out_many", f"WITH {PROPS}, {EDGES} SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'PLACED' AND src IN (SELECT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'MACHINERY')")
def g_out_many(spark, d):
    g = graph(spark, d, ("PLACED",))
    return g.hop(g.by_property("mktsegment", "MACHINERY"), "out", "PLACED")


@query("g_in_many", f"WITH {PROPS}, {EDGES} SELECT DISTINCT src AS obj_id FROM edges WHERE rel = 'CONTAINS' AND dst IN (SELECT obj_id FROM props WHERE field = 'brand' AND sval = 'Brand#1')")
def g_in_many(spark, d):
    g = graph(spark, d, ("CONTAINS",))
    return g.hop(g.by_property("brand", "Brand#1"), "in", "CONTAINS")


@query("g_has_rel", f"WITH {EDGES}, asked AS (SELECT unnest([[{_C}, {_C + 1}], [{_C + 1}, {_C}], [{_C}, {_C}]]) AS p) SELECT p[1] AS src, p[2] AS dst, EXISTS (SELECT 1 FROM edges WHERE rel = 'KNOWS' AND src = p[1] AND dst = p[2]) AS related FROM asked")
def g_has_rel(spark, d):
    asked = spark.createDataFrame([(_C, _C + 1), (_C + 1, _C), (_C, _C)], "src long, dst long")
    return graph(spark, d, ("KNOWS",)).related(asked, "KNOWS")


@query("g_mutual", f"WITH {EDGES} SELECT DISTINCT a.src AS a, a.dst AS b FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.rel = 'KNOWS' AND b.rel = 'KNOWS' AND a.src < a.dst")
def g_mutual(spark, d):
    return graph(spark, d, ("KNOWS",)).mutual("KNOWS")


@query("g_common_neighbors", f"WITH {EDGES} SELECT dst AS obj_id FROM edges WHERE src = {_C} AND rel = 'KNOWS' INTERSECT SELECT dst FROM edges WHERE src = {_C + 1} AND rel = 'KNOWS'")
def g_common_neighbors(spark, d):
    return graph(spark, d, ("KNOWS",)).common_neighbours(_C, _C + 1, "KNOWS")


@query(
    "g_shortest_path",
    f"""WITH RECURSIVE {EDGES}, e AS (SELECT src, dst FROM edges WHERE rel = 'KNOWS'), walk AS (
      SELECT CAST({_C + 3} AS BIGINT) AS node, [CAST({_C + 3} AS BIGINT)] AS path
      UNION ALL
      SELECT node, path FROM (SELECT e.dst AS node, min(list_append(w.path, e.dst)) AS path FROM walk w JOIN e ON e.src = w.node WHERE len(w.path) < 12 AND w.node <> {_C + 100} AND NOT list_contains(w.path, e.dst) GROUP BY e.dst)
    ), best AS (SELECT path FROM walk WHERE node = {_C + 100} ORDER BY len(path), path LIMIT 1)
    SELECT CAST(unnest(range(len(path))) AS INTEGER) AS pos, unnest(path) AS obj_id FROM best""",
)
def g_shortest_path(spark, d):
    return algorithms.shortest_path(T.edges(spark, d, ("KNOWS",)), _C + 3, _C + 100, "KNOWS")


@query("g_triangles", f"WITH {EDGES}, e AS (SELECT src, dst FROM edges WHERE rel = 'KNOWS') SELECT CAST(count(*) // 3 AS BIGINT) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst")
def g_triangles(spark, d):
    return algorithms.triangles(T.edges(spark, d, ("KNOWS",)), "KNOWS")


@query("g_triangles_undirected", f"WITH {EDGES}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE rel = 'KNOWS') SELECT count(*) AS triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def g_triangles_undirected(spark, d):
    return algorithms.triangles_undirected(T.edges(spark, d, ("KNOWS",)), "KNOWS")


@query("g_degrees", f"WITH {EDGES} SELECT src AS obj_id, count(*) AS n FROM edges WHERE rel = 'KNOWS' GROUP BY src")
def g_degrees(spark, d):
    return algorithms.degrees(T.edges(spark, d, ("KNOWS",)), "KNOWS")


@query("g_walk", f"WITH {EDGES} SELECT DISTINCT a.src AS start, c.dst AS obj_id FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND a.src = {_C + 7} AND c.rel = 'X' UNION SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'PLACED' AND b.rel = 'CONTAINS' AND a.src = {_C + 7}")
def g_walk(spark, d):
    start = spark.createDataFrame([(_C + 7,)], "obj_id long")
    return algorithms.node_paths(spark, T.edges(spark, d, ("PLACED", "CONTAINS")), start, ["PLACED", "CONTAINS"])


# step plans
def _plan(spark: SparkSession, d: str, *rels: str) -> Query:
    return Query(graph(spark, d, rels))


def _having(field: str, test: str) -> str:
    return f"obj_id IN (SELECT obj_id FROM props WHERE field = '{field}' AND {test})"


@query("p_find_and", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE {_having('type', chr(39).join(['sval = ', 'part', '']))} AND {_having('brand', chr(39).join(['sval = ', 'Brand#2', '']))} AND {_having('size', 'nval = 7')}")
def p_find_and(spark, d):
    return _plan(spark, d).find({"type": "part", "brand": "Brand#2", "size": 7}).ids()


@query(
    "p_find_or_fold",
    f"""WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE ((({_having('brand', "sval = 'Brand#1'")} AND {_having('size', 'nval <= 10')}) OR {_having('brand', "sval = 'Brand#3'")}) AND {_having('size', 'nval >= 5')})""",
)
def p_find_or_fold(spark, d):
    return _plan(spark, d).find([{"brand": "Brand#1", "size": {"lte": 10}}, {"brand": "Brand#3", "size": {"gte": 5}}]).ids()


@query("p_filter", f"""WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE {_having('type', "sval = 'customer'")} AND {_having('mktsegment', "sval = 'BUILDING'")} AND {_having('acctbal_cents', 'nval > 500000')}""")
def p_filter(spark, d):
    return _plan(spark, d).find({"type": "customer"}).filter({"mktsegment": "BUILDING", "acctbal_cents": {"gt": 500_000}}).ids()


@query("p_union", f"""WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE {_having('brand', "sval = 'Brand#1'")} OR {_having('mktsegment', "sval = 'MACHINERY'")} OR {_having('size', 'nval = 3')}""")
def p_union(spark, d):
    return _plan(spark, d).find({"brand": "Brand#1"}).union({"mktsegment": "MACHINERY", "size": 3}).ids()


@query("p_traverse_out", f"""WITH {PROPS}, {EDGES} SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'PLACED' AND src IN (SELECT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'BUILDING')""")
def p_traverse_out(spark, d):
    return _plan(spark, d, "PLACED").find({"mktsegment": "BUILDING"}).traverse("out", "PLACED").ids()


@query("p_traverse_in", f"""WITH {PROPS}, {EDGES} SELECT DISTINCT src AS obj_id FROM edges WHERE rel = 'PLACED' AND dst IN (SELECT obj_id FROM props WHERE field = 'status' AND sval = 'P')""")
def p_traverse_in(spark, d):
    return _plan(spark, d, "PLACED").find({"status": "P"}).traverse("in", "PLACED").ids()


@query(
    "p_traverse_filter",
    f"""WITH {PROPS}, {EDGES}, met AS (SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'PLACED' AND src IN (SELECT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'BUILDING'))
    SELECT obj_id FROM met WHERE {_having('status', "sval = 'O'")} AND {_having('total_cents', 'nval >= 10000000')}""",
)
def p_traverse_filter(spark, d):
    return _plan(spark, d, "PLACED").find({"mktsegment": "BUILDING"}).traverse("out", "PLACED", {"status": "O", "total_cents": {"gte": 10_000_000}}).ids()


@query(
    "p_two_hop",
    f"""WITH {PROPS}, {EDGES}, met AS (SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'KNOWS' AND src IN (SELECT obj_id FROM props WHERE field = 'name' AND sval = 'Customer#000000003'))
    SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'KNOWS' AND src IN (SELECT obj_id FROM met)""",
)
def p_two_hop(spark, d):
    return _plan(spark, d, "KNOWS").find({"name": "Customer#000000003"}).traverse("out", "KNOWS").traverse("out", "KNOWS").ids()


@query("p_range_open_low", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE {_having('retail_cents', 'nval < 100000')}")
def p_range_open_low(spark, d):
    return _plan(spark, d).find({"retail_cents": {"lt": 100_000}}).ids()


@query("p_range_open_high", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE {_having('total_cents', 'nval > 20000000')}")
def p_range_open_high(spark, d):
    return _plan(spark, d).find({"total_cents": {"gt": 20_000_000}}).ids()


# places
GEO = """cells AS (
  SELECT obj_id, lat, lon, 0 AS k, -90.0::DOUBLE AS a, 90.0::DOUBLE AS b, -180.0::DOUBLE AS c, 180.0::DOUBLE AS d, 0::UBIGINT AS h FROM points
  UNION ALL
  SELECT obj_id, lat, lon, k + 1,
    CASE WHEN k % 2 = 1 AND lat > (a + b) / 2 THEN (a + b) / 2 ELSE a END, CASE WHEN k % 2 = 1 AND lat <= (a + b) / 2 THEN (a + b) / 2 ELSE b END,
    CASE WHEN k % 2 = 0 AND lon > (c + d) / 2 THEN (c + d) / 2 ELSE c END, CASE WHEN k % 2 = 0 AND lon <= (c + d) / 2 THEN (c + d) / 2 ELSE d END,
    ((h & 9223372036854775807::UBIGINT) * 2::UBIGINT + CASE WHEN (k % 2 = 0 AND lon > (c + d) / 2) OR (k % 2 = 1 AND lat > (a + b) / 2) THEN 1::UBIGINT ELSE 0::UBIGINT END)::UBIGINT
  FROM cells WHERE k < 64
), places AS (SELECT obj_id, lat, lon, h FROM cells WHERE k = 64)"""
POINTS = f"points AS (SELECT {_S} + s_suppkey AS obj_id, CAST((s_suppkey * 37) % 180 - 89.5 AS DOUBLE) AS lat, CAST((s_suppkey * 91) % 360 - 179.5 AS DOUBLE) AS lon FROM supplier"


def _places(spark: SparkSession, d: str) -> Graph:
    return Graph(T.geo_props(spark, d), spark.createDataFrame([], T.EDGES))


@query("geo_encode", f"WITH RECURSIVE {POINTS}), {GEO} SELECT obj_id, CAST(h AS VARCHAR) AS geohash FROM places")
def geo_encode(spark, d):
    return T.geo_props(spark, d).select("obj_id", S.unsigned("nval").cast("string").alias("geohash"))


@query("geo_decode", f"WITH RECURSIVE {POINTS}), {GEO} SELECT obj_id, round((a + b) / 2, 6) AS lat, round((c + d) / 2, 6) AS lon FROM cells WHERE k = 64")
def geo_decode(spark, d):
    at = S.geohash_decode("nval")
    return T.geo_props(spark, d).select("obj_id", F.round(at["lat"], 6).alias("lat"), F.round(at["lon"], 6).alias("lon"))


@query("geo_point", f"WITH {POINTS}) SELECT DISTINCT obj_id FROM points WHERE lat = -52.5 AND lon = -88.5")
def geo_point(spark, d):
    return Query(_places(spark, d)).find({"place": {"lat": -52.5, "lon": -88.5}}).ids()


_LAT, _LON, _METRES = 10.0, 20.0, 3_000_000.0
_BOX = f"({_METRES} / 111320.0)", f"({_METRES} / (111320.0 * cos(radians({_LAT}))))"


@query(
    "geo_near_zrange",
    f"""WITH RECURSIVE {POINTS} UNION ALL SELECT -1, {_LAT} - {_BOX[0]}, {_LON} - {_BOX[1]} UNION ALL SELECT -2, {_LAT} + {_BOX[0]}, {_LON} + {_BOX[1]}), {GEO}, ends AS (SELECT min(h) AS lo, max(h) AS hi FROM places WHERE obj_id < 0)
    SELECT DISTINCT obj_id FROM places, ends WHERE obj_id > 0 AND h BETWEEN lo AND hi""",
)
def geo_near_zrange(spark, d):
    return Query(_places(spark, d)).find({"place": {"near": {"lat": _LAT, "lon": _LON}, "radius": _METRES}}).ids()


@query(
    "geo_near_radius",
    f"""WITH {POINTS}) SELECT DISTINCT obj_id FROM points WHERE lat BETWEEN {_LAT} - {_BOX[0]} AND {_LAT} + {_BOX[0]} AND lon BETWEEN {_LON} - {_BOX[1]} AND {_LON} + {_BOX[1]}
    AND 2 * {S.EARTH_RADIUS} * asin(sqrt(least(1.0, pow(sin((radians({_LAT}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({_LAT})) * pow(sin((radians({_LON}) - radians(lon)) / 2), 2)))) <= {_METRES}""",
)
def geo_near_radius(spark, d):
    return Query(_places(spark, d)).find({"place": {"near": {"lat": _LAT, "lon": _LON}, "radius": _METRES, "mode": "radius"}}).ids()


# objects
@query(
    "obj_pivot",
    f"""WITH {PROPS} SELECT obj_id, max(CASE WHEN field = 'type' THEN sval END) AS type, max(CASE WHEN field = 'name' THEN sval END) AS name, CAST(max(CASE WHEN field = 'size' THEN nval END) AS VARCHAR) AS size
    FROM props WHERE {_having('brand', "sval = 'Brand#1'")} GROUP BY obj_id""",
)
def obj_pivot(spark, d):
    return _plan(spark, d).find({"brand": "Brand#1"}).execute().wide(["type", "name", "size"])


@query("obj_map", f"""WITH {PROPS} SELECT obj_id, field, coalesce(sval, CAST(nval AS VARCHAR)) AS value FROM props WHERE {_having('size', 'nval = 1')}""")
def obj_map(spark, d):
    return _plan(spark, d).find({"size": 1}).execute().objects().select("obj_id", F.explode("object").alias("field", "value"))


@query("obj_page", f"""WITH {PROPS}, ids AS (SELECT DISTINCT obj_id FROM props WHERE {_having('type', "sval = 'nation'")} ORDER BY obj_id LIMIT 10 OFFSET 10) SELECT obj_id, field, coalesce(sval, CAST(nval AS VARCHAR)) AS value FROM props WHERE obj_id IN (SELECT obj_id FROM ids)""")
def obj_page(spark, d):
    return _plan(spark, d).find({"type": "nation"}).execute().page(2, 10).select("obj_id", F.explode("object").alias("field", "value"))


# writes
_TEXT = "coalesce(sval, CAST(nval AS VARCHAR)) AS value"
_NEXT = "(SELECT max(obj_id) FROM props)"


@query("w_update_object", f"""WITH {PROPS} SELECT obj_id, field, {_TEXT} FROM props WHERE obj_id <> {_N} UNION ALL SELECT {_N}, 'name', 'renamed' UNION ALL SELECT {_N}, 'rank', '1'""")
def w_update_object(spark, d):
    after = facts.update_objects(T.props(spark, d), facts.rows_of(spark, {_N: {"name": "renamed", "rank": True, "none": None}}))
    return after.select("obj_id", "field", value_text().alias("value"))


@query("w_update_fact", f"""WITH {PROPS} SELECT obj_id, field, CASE WHEN obj_id = {_N} AND field = 'name' THEN 'renamed' WHEN obj_id = {_P} AND field = 'size' THEN 'large' ELSE coalesce(sval, CAST(nval AS VARCHAR)) END AS value FROM props""")
def w_update_fact(spark, d):
    after = facts.update_fact(T.props(spark, d), facts.rows_of(spark, {_N: {"name": "renamed"}, _P: {"size": "large"}}))
    return after.select("obj_id", "field", value_text().alias("value"))


@query(
    "w_delete_object",
    f"""WITH {PROPS}, {EDGES} SELECT 'fact' AS kind, obj_id, field AS name FROM props WHERE obj_id <> {_N + 1}
    UNION ALL SELECT 'edge', src, rel || CAST(dst AS VARCHAR) FROM edges WHERE src <> {_N + 1} AND dst <> {_N + 1}""",
)
def w_delete_object(spark, d):
    gone = spark.createDataFrame([(_N + 1,)], "obj_id long")
    props, edges = facts.delete_objects(T.props(spark, d), T.edges(spark, d), gone)
    return _names(props, edges)


def _names(props: DataFrame, edges: DataFrame) -> DataFrame:
    related = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("obj_id"), F.concat("rel", F.col("dst").cast("string")).alias("name"))
    return props.select(F.lit("fact").alias("kind"), "obj_id", F.col("field").alias("name")).unionByName(related)


@query("w_insert_edges", f"WITH {EDGES} SELECT src, rel, dst FROM edges UNION SELECT {_N}, 'IN_REGION', {_R + 1}")
def w_insert_edges(spark, d):
    return facts.insert_edges(T.edges(spark, d), facts.edge_rows(spark, [(_N, "IN_REGION", _R + 1), (_N, "IN_REGION", _R + 1)])).select("src", "rel", "dst")


@query("w_insert_object", f"WITH {PROPS} SELECT obj_id, field, {_TEXT} FROM props UNION ALL SELECT {_NEXT} + 1, unnest(['type', 'name', 'size']), unnest(['region', 'NOWHERE', '3'])")
def w_insert_object(spark, d):
    after, _ = facts.insert_objects(T.props(spark, d), [{"nothing": None}, {"type": "region", "name": "NOWHERE", "size": 3.7}])
    return after.select("obj_id", "field", value_text().alias("value"))


@query("w_remove_edges", f"WITH {EDGES} SELECT src, rel, dst FROM edges WHERE dst <> {_R + 1}")
def w_remove_edges(spark, d):
    return facts.remove_edges(T.edges(spark, d), spark.createDataFrame([(_R + 1,)], "dst long")).select("src", "rel", "dst")


@query("w_remove_fact", f"WITH {PROPS} SELECT obj_id, field FROM props WHERE NOT (obj_id = {_R} AND field = 'name')")
def w_remove_fact(spark, d):
    return facts.remove_props(T.props(spark, d), (F.col("obj_id") == _R) & (F.col("field") == "name")).select("obj_id", "field")


# databases
def _with_database(spark: SparkSession, use: Callable[[Database], DataFrame]) -> DataFrame:
    """What a function reads of a new database in the shared folder, which is dropped then."""
    db = Database.create(spark, f"{scratch.shared_dir(spark)}/db-{uuid.uuid4().hex}")
    try:
        return scratch.checkpoint(use(db))
    finally:
        Database.drop(spark, db.root)


def _load_orders(db: Database, d: str) -> int:
    return db.insert_batch("orders", T.order_log(db.spark, d).select("key", "value"))


@query("w_abort", f"WITH {ORDER_KV} SELECT key, value FROM kv")
def w_abort(spark, d):
    """Commits all orders, then aborts changes to all of them."""

    def use(db):
        _load_orders(db, d)
        txn = db.begin()
        txn.insert_frame("orders", T.order_log(spark, d).select("key", F.lit("changed").alias("value")))
        txn.remove("orders", "order:0000000002")
        txn.abort()
        return db.collection("orders").scan()

    return _with_database(spark, use)


@query("w_remove", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE key <> 'order:0000000003'")
def w_remove(spark, d):
    def use(db):
        _load_orders(db, d)
        db.remove("orders", "order:0000000003")
        db.remove("orders", "nowhere")
        return db.collection("orders").scan()

    return _with_database(spark, use)


@query("w_insert_batch", f"WITH {ORDER_KV} SELECT key, CASE WHEN key = 'order:0000000004' THEN 'second' ELSE value END AS value FROM kv UNION ALL SELECT 'order:x', 'new'")
def w_insert_batch(spark, d):
    def use(db):
        _load_orders(db, d)
        db.insert_batch("orders", [("order:0000000004", "first"), ("order:x", "new"), ("order:0000000004", "second")])
        return db.collection("orders").scan()

    return _with_database(spark, use)


@query("w_repeated_keys", "SELECT 'event:' || event_type AS key, arg_max(CAST(user_id AS VARCHAR), event_id) AS value FROM events GROUP BY 1")
def w_repeated_keys(spark, d):
    """A frame with many rows of each key: the last in the stated order wins."""

    def use(db):
        txn = db.begin()
        rows = T.table(spark, d, "events").select(F.concat(F.lit("event:"), "event_type").alias("key"), F.col("user_id").cast("string").alias("value"), "event_id")
        txn.insert_frame("events", rows, "event_id")
        txn.commit()
        return db.collection("events").scan()

    return _with_database(spark, use)


@query("w_execute_batch", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE key NOT IN ('order:0000000001', 'order:0000000002') UNION ALL SELECT 'order:0000000002', 'again'")
def w_execute_batch(spark, d):
    def use(db):
        _load_orders(db, d)
        txn = db.begin()
        txn.execute_batch("orders", [("insert", "order:0000000001", "x"), ("remove", "order:0000000001"), ("remove", "order:0000000002"), ("insert", "order:0000000002", "again")])
        txn.commit()
        return db.collection("orders").scan()

    return _with_database(spark, use)


@query("w_single_ops", f"WITH {ORDER_KV} SELECT key, CASE WHEN key = 'order:0000000005' THEN 'x' ELSE value END AS value FROM kv WHERE key <> 'order:0000000006'")
def w_single_ops(spark, d):
    def use(db):
        _load_orders(db, d)
        db.insert("orders", "order:0000000005", "x")
        db.remove("orders", "order:0000000006")
        return db.collection("orders").scan()

    return _with_database(spark, use)


@query("w_read_own_writes", f"WITH {ORDER_KV} SELECT key, CASE WHEN key = 'order:0000000001' THEN 'mine' ELSE value END AS value FROM kv WHERE key <> 'order:0000000002'")
def w_read_own_writes(spark, d):
    """An open transaction reads its snapshot and its own writes, and nothing that another one commits meanwhile."""

    def use(db):
        _load_orders(db, d)
        txn = db.begin()
        txn.insert("orders", "order:0000000001", "mine")
        txn.remove("orders", "order:0000000002")
        db.insert("orders", "order:0000000003", "another's")
        return txn.collection("orders").scan()

    return _with_database(spark, use)


@query(
    "w_reopen_at_snapshot",
    f"WITH {ORDER_KV} SELECT 'then' AS state, key, value FROM kv UNION ALL SELECT 'now', key, CASE WHEN key = 'order:0000000001' THEN 'changed' ELSE value END FROM kv WHERE key <> 'order:0000000002'",
)
def w_reopen_at_snapshot(spark, d):
    """Two commits, a compaction between them and a reader at the first one's snapshot, in a database that is opened anew."""

    def use(db):
        first = _load_orders(db, d)
        reader = db.begin(first)
        txn = db.begin()
        txn.insert("orders", "order:0000000001", "changed")
        txn.remove("orders", "order:0000000002")
        txn.commit()
        db.close()
        again = Database.open(spark, db.root)
        again.compact()
        then = reader.collection("orders").scan()
        return then.select(F.lit("then").alias("state"), "key", "value").unionByName(again.collection("orders").scan().select(F.lit("now").alias("state"), "key", "value"))

    return _with_database(spark, use)


@query("w_commit_ids", "SELECT unnest([0, 1, 2, 3]) AS pos, unnest([1, 2, 10, 11]) AS txn_id")
def w_commit_ids(spark, d):
    """Ids of commits rise by one, or are those asked for."""

    def use(db):
        ids = [db.insert("c", "k", "1"), db.remove("c", "k")]
        txn = db.begin()
        txn.insert("c", "k", "2")
        ids += [txn.commit(10), db.insert("c", "k", "3")]
        return spark.createDataFrame(list(enumerate(ids)), "pos int, txn_id int")

    return _with_database(spark, use)


@query("w_collections", f"WITH {ORDER_KV} SELECT 'orders' AS collection, count(*) AS n FROM kv UNION ALL SELECT 'others', 1")
def w_collections(spark, d):
    """Collections come into being when they are written to, and keep apart."""

    def use(db):
        _load_orders(db, d)
        db.insert("others", "order:0000000001", "x")
        return db.collections().join(kv.latest(db.log()), "collection").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))

    return _with_database(spark, use)


@query("stream_current", f"WITH {LOG}, {_latest_sql()} SELECT collection, key, v.value AS value, txn_id FROM (SELECT 'users' AS collection, * FROM latest) WHERE NOT v.is_deleted")
def stream_current(spark, d):
    """The whole log as a stream of files, two at least, and the table of current values that its batches maintain."""
    root = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    try:
        log = T.user_log(spark, d)
        log.repartition(max(2, sizes.parts(log)), "generation", "key").write.parquet(f"{root}/log")
        current.maintain(current.log_stream(spark, f"{root}/log"), f"{root}/kept", f"{root}/progress").awaitTermination()
        return scratch.checkpoint(current.current(spark, f"{root}/kept"))
    finally:
        Database.drop(spark, root)


# graph transactions
def _load_graph(db: Database, d: str, props: DataFrame | None = None) -> int:
    txn = graph_transactions.GraphTransaction(db)
    txn.load(T.props(db.spark, d) if props is None else props, T.edges(db.spark, d))
    return txn.commit()


def _values(g: Graph) -> DataFrame:
    related = g.edges.select(F.col("src").alias("obj_id"), F.col("rel").alias("field"), F.col("dst").cast("string").alias("value"))
    return g.props.select("obj_id", "field", value_text().alias("value")).unionByName(related)


@query(
    "gt_commit",
    f"""WITH {PROPS}, {EDGES} SELECT obj_id, field, {_TEXT} FROM props WHERE obj_id <> {_N} UNION ALL SELECT src, rel, CAST(dst AS VARCHAR) FROM edges WHERE NOT (src = {_N + 1} AND rel = 'IN_REGION')
    UNION ALL SELECT {_N}, 'name', 'renamed' UNION ALL SELECT {_NEXT} + 1, unnest(['type', 'name', 'IN_REGION']), unnest(['nation', 'NOWHERE', '{_R}'])""",
)
def gt_commit(spark, d):
    def use(db):
        _load_graph(db, d)
        txn = graph_transactions.GraphTransaction(db)
        new = txn.insert_object({"type": "nation", "name": "NOWHERE", "none": None})
        txn.insert_relationship(new, "IN_REGION", _R)
        txn.update_object(_N, {"name": "renamed"})
        txn.remove_relationship(*_region_of(spark, d, _N + 1))
        txn.commit()
        return _values(graph_transactions.graph(db))

    return _with_database(spark, use)


def _region_of(spark: SparkSession, d: str, nation: int) -> tuple[int, str, int]:
    return tuple(T.edges(spark, d, ("IN_REGION",)).where(F.col("src") == nation).first())


@query("gt_abort", f"WITH {PROPS}, {EDGES} SELECT obj_id, field, {_TEXT} FROM props UNION ALL SELECT src, rel, CAST(dst AS VARCHAR) FROM edges UNION ALL SELECT {_NEXT} + 3, 'name', 'kept'")
def gt_abort(spark, d):
    """Nothing of an aborted transaction is kept, but its ids are not given out again."""

    def use(db):
        _load_graph(db, d)
        txn = graph_transactions.GraphTransaction(db)
        for name in ("one", "two"):
            txn.insert_object({"name": name})
        txn.delete_object(_N)
        txn.abort()
        txn = graph_transactions.GraphTransaction(db)
        txn.insert_object({"name": "kept"})
        txn.commit()
        return _values(graph_transactions.graph(db))

    return _with_database(spark, use)


@query("gt_delete_reopen", f"WITH {PROPS}, {EDGES} SELECT obj_id, field, {_TEXT} FROM props WHERE obj_id NOT IN ({_N + 1}, {_C}) UNION ALL SELECT src, rel, CAST(dst AS VARCHAR) FROM edges WHERE src NOT IN ({_N + 1}, {_C}) AND dst NOT IN ({_N + 1}, {_C})")
def gt_delete_reopen(spark, d):
    def use(db):
        _load_graph(db, d)
        txn = graph_transactions.GraphTransaction(db)
        txn.delete_object(_N + 1)
        txn.delete_object(_C)
        txn.commit()
        db.close()
        return _values(graph_transactions.graph(Database.open(spark, db.root)))

    return _with_database(spark, use)


@query(
    "gt_snapshot",
    f"""WITH {PROPS}, {EDGES}, facts AS (SELECT obj_id, field, {_TEXT} FROM props UNION ALL SELECT src, rel, CAST(dst AS VARCHAR) FROM edges)
    SELECT 'then' AS state, * FROM facts UNION ALL SELECT 'now', * FROM facts WHERE obj_id <> {_R} AND NOT (field = 'IN_REGION' AND value = '{_R}')""",
)
def gt_snapshot(spark, d):
    """The graph as of the first of two commits, and as it is."""

    def use(db):
        first = _load_graph(db, d)
        txn = graph_transactions.GraphTransaction(db)
        txn.delete_object(_R)
        txn.commit()
        then, now = graph_transactions.graph(db, first), graph_transactions.graph(db)
        return _values(then).select(F.lit("then").alias("state"), "*").unionByName(_values(now).select(F.lit("now").alias("state"), "*"))

    return _with_database(spark, use)


@query(
    "gt_single_facts",
    f"""WITH {PROPS} SELECT obj_id, field, CASE WHEN obj_id = {_P} AND field = 'size' THEN 'large' WHEN obj_id = {_P + 1} AND field = 'size' THEN '99' WHEN obj_id = {_P + 2} AND field = 'name' THEN '7' ELSE coalesce(sval, CAST(nval AS VARCHAR)) END AS value
    FROM props WHERE NOT (obj_id = {_P + 3} AND field = 'brand')""",
)
def gt_single_facts(spark, d):
    """Single values set and removed; a value of another type takes the place of the old one."""

    def use(db):
        _load_graph(db, d)
        txn = graph_transactions.GraphTransaction(db)
        txn.set_string(_P, "size", "large")
        txn.set_numeric(_P + 1, "size", 99.5)
        txn.set_numeric(_P + 2, "name", 7)
        txn.remove_fact(_P + 3, "brand")
        txn.commit()
        return graph_transactions.graph(db).props.select("obj_id", "field", value_text().alias("value"))

    return _with_database(spark, use)


@query("gt_geo_fact", f"WITH {POINTS}) SELECT obj_id, CASE WHEN obj_id = {_S} THEN 10.5 ELSE lat END AS lat, CASE WHEN obj_id = {_S} THEN 20.25 ELSE lon END AS lon, obj_id = {_S} AS found FROM points")
def gt_geo_fact(spark, d):
    def use(db):
        _load_graph(db, d, T.geo_props(spark, d))
        txn = graph_transactions.GraphTransaction(db)
        txn.set_geo(_S, "place", 10.5, 20.25)
        txn.commit()
        g = graph_transactions.graph(db)
        found = g.at_place("place", 10.5, 20.25).withColumn("found", F.lit(True))
        return g.props.join(found, "obj_id", "left").select("obj_id", "lat", "lon", F.coalesce("found", F.lit(False)).alias("found"))

    return _with_database(spark, use)


# a graph laid down by fields and types
def _laid_down(spark: SparkSession, d: str, use: Callable[[Graph], DataFrame]) -> DataFrame:
    path = f"{scratch.shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    try:
        Graph(T.props(spark, d), T.edges(spark, d)).write(path)
        return scratch.checkpoint(use(Graph.read(spark, path)))
    finally:
        Database.drop(spark, path)


@query("g_partitioned_property", f"WITH {PROPS} SELECT DISTINCT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'BUILDING'")
def g_partitioned_property(spark, d):
    return _laid_down(spark, d, lambda g: g.by_property("mktsegment", "BUILDING"))


@query("g_partitioned_hop", f"WITH {PROPS}, {EDGES} SELECT DISTINCT dst AS obj_id FROM edges WHERE rel = 'PLACED' AND src IN (SELECT obj_id FROM props WHERE field = 'mktsegment' AND sval = 'MACHINERY')")
def g_partitioned_hop(spark, d):
    return _laid_down(spark, d, lambda g: g.hop(g.by_property("mktsegment", "MACHINERY"), "out", "PLACED"))


# cursors, iterators, pages
@query("kv_cursor", f"WITH {ORDER_KV} SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key, value FROM kv WHERE key >= 'order:0000000100' AND key < 'order:0000000200'")
def kv_cursor(spark, d):
    steps = _orders(spark, d).cursor("order:0000000100", "order:0000000200")
    return spark.createDataFrame([(n, *row) for n, row in enumerate(steps)], "pos long, key string, value string")


@query("kv_page_default", f"WITH {ORDER_KV} SELECT key, value FROM kv ORDER BY key LIMIT 50")
def kv_page_default(spark, d):
    return results.page(_orders(spark, d).current(), "key")


@query("kv_page_after", f"WITH {ORDER_KV} SELECT key, value FROM kv WHERE key > 'order:0000000120' ORDER BY key LIMIT 25")
def kv_page_after(spark, d):
    return results.page_after(_orders(spark, d).current(), "key", "order:0000000120", 25)


@query("kv_page_totals", f"WITH {ORDER_KV}, n AS (SELECT count(*) AS n FROM kv) SELECT n AS total_results, CAST((n + 39) // 40 AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS page, CAST(greatest(0, least(40, n - 80)) AS BIGINT) AS results_in_page FROM n")
def kv_page_totals(spark, d):
    return results.page_totals(_orders(spark, d).current(), 3, 40)


@query("obj_total_count", f"WITH {PROPS} SELECT count(DISTINCT obj_id) AS n FROM props WHERE {_having('brand', "sval = 'Brand#1'")}")
def obj_total_count(spark, d):
    return spark.createDataFrame([(_plan(spark, d).find({"brand": "Brand#1"}).execute().total_count(),)], "n long")


@query("obj_iterator", f"WITH {PROPS} SELECT dense_rank() OVER (ORDER BY obj_id) - 1 AS pos, obj_id, field, {_TEXT} FROM props WHERE {_having('type', "sval = 'nation'")}")
def obj_iterator(spark, d):
    found = _plan(spark, d).find({"type": "nation"}).execute()
    return spark.createDataFrame([(n, o["id"], f, v) for n, o in enumerate(found) for f, v in o.items() if f != "id"], "pos long, obj_id long, field string, value string")


@query("obj_page_after", f"WITH {PROPS}, ids AS (SELECT DISTINCT obj_id FROM props WHERE {_having('type', "sval = 'nation'")} AND obj_id > {_N + 9} ORDER BY obj_id LIMIT 10) SELECT obj_id, field, {_TEXT} FROM props WHERE obj_id IN (SELECT obj_id FROM ids)")
def obj_page_after(spark, d):
    return _plan(spark, d).find({"type": "nation"}).execute().page_after(_N + 9, 10).select("obj_id", F.explode("object").alias("field", "value"))


@query("obj_page_totals", "SELECT count(*) AS total_results, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS page, CAST(greatest(0, least(10, count(*) - 20)) AS BIGINT) AS results_in_page FROM nation")
def obj_page_totals(spark, d):
    return _plan(spark, d).find({"type": "nation"}).execute().totals(3, 10)


# analytics
@query("agg_group_sum", "SELECT CAST(o_custkey % 10 AS BIGINT) AS warehouse, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def agg_group_sum(spark, d):
    lines, orders = T.table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy((F.col("o_custkey") % 10).alias("warehouse")).agg(F.sum(T.cents("l_extendedprice")).alias("cents"))


@query("agg_set_intersection", f"SELECT {_C} + c_custkey AS obj_id FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 25 = 0")
def agg_set_intersection(spark, d):
    all_ids = T.table(spark, d, "customer")
    premium = sets.ids(all_ids.where("c_custkey % 10 = 0").select(T.obj_id("customer", "c_custkey").alias("obj_id")))
    forum = sets.ids(all_ids.where("c_custkey % 25 = 0").select(T.obj_id("customer", "c_custkey").alias("obj_id")))
    return sets.intersect(premium, forum)


@query("agg_new_order", "SELECT o_orderkey, count(*) AS lines, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = 7 GROUP BY o_orderkey")
def agg_new_order(spark, d):
    """What one customer's orders read: their lines and the prices of their parts."""
    orders = T.table(spark, d, "orders").where("o_custkey = 7").select("o_orderkey")
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = T.table(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(T.cents("p_retailprice") * F.col("l_quantity").cast("long")).alias("cents"))


# scalar functions
@query("fn_fnv1a", "WITH RECURSIVE names AS (SELECT n_name AS name FROM nation UNION ALL SELECT ''), h AS (SELECT name, 0 AS k, 2166136261::BIGINT AS h FROM names UNION ALL SELECT name, k + 1, (xor(h, ascii(substr(name, k + 1, 1))::BIGINT) * 16777619) & 4294967295 FROM h WHERE k < length(name)) SELECT name, h AS hash FROM h WHERE k = length(name)")
def fn_fnv1a(spark, d):
    names = T.table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("",)], "name string"))
    return names.select("name", S.fnv1a32("name").alias("hash"))


@query("fn_zpad_key", "SELECT p_partkey AS id, 'idx:part:' || lpad(CAST(p_size AS VARCHAR), 20, '0') AS key, 'part/' || p_brand AS path FROM part")
def fn_zpad_key(spark, d):
    rows = T.table(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), S.sortable_key(F.lit("idx:part"), "p_size").alias("key"), F.concat(S.path_of(S.path_key(F.lit("part"), "p_brand")), F.lit("/"), S.value_of(S.path_key(F.lit("part"), "p_brand"))).alias("path"))


@query("fn_bitpack", "SELECT c_custkey AS id, (CAST(c_nationkey AS BIGINT) << 48) | (CAST(c_custkey % 100 AS BIGINT) << 40) | (CAST(c_custkey % 4 AS BIGINT) << 38) AS packed FROM customer")
def fn_bitpack(spark, d):
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.bit_pack("c_nationkey", F.col("c_custkey") % 100, F.col("c_custkey") % 4).alias("packed"))


def _spread_sql(x: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


@query("fn_zorder", f"WITH v AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) & 65535 AS a, CAST(p_partkey AS BIGINT) & 65535 AS b, CAST(p_partkey % 7 AS BIGINT) & 65535 AS c FROM part) SELECT id, ({_spread_sql('a')} << 2) | ({_spread_sql('b')} << 1) | {_spread_sql('c')} AS z FROM v")
def fn_zorder(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.z_order3("p_size", "p_partkey", F.col("p_partkey") % 7).alias("z"))


@query("fn_to_number", "SELECT DISTINCT p_name AS text, CAST(try_cast(CASE WHEN regexp_full_match(p_name, '[0-9]+') THEN p_name END AS DECIMAL(20, 0)) AS BIGINT) AS n FROM part UNION SELECT CAST(p_size AS VARCHAR), CAST(p_size AS BIGINT) FROM part")
def fn_to_number(spark, d):
    rows = T.table(spark, d, "part")
    texts = rows.select(F.col("p_name").alias("text")).unionByName(rows.select(F.col("p_size").cast("string").alias("text"))).distinct()
    return texts.select("text", S.to_number("text").cast("long").alias("n"))


# sets of ids
def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = graph(spark, d)
    return g.by_property("brand", "Brand#1"), g.by_range("size", 10, 30)


_A, _B = "SELECT obj_id FROM props WHERE field = 'brand' AND sval = 'Brand#1'", "SELECT obj_id FROM props WHERE field = 'size' AND nval BETWEEN 10 AND 30"


@query("set_intersect", f"WITH {PROPS} {_A} INTERSECT {_B}")
def set_intersect(spark, d):
    return sets.intersect(*_sets(spark, d))


@query("set_union", f"WITH {PROPS} {_A} UNION {_B}")
def set_union(spark, d):
    return sets.union(*_sets(spark, d))


@query("set_andnot", f"WITH {PROPS} {_A} EXCEPT {_B}")
def set_andnot(spark, d):
    return sets.and_not(*_sets(spark, d))


@query("set_cardinality", f"WITH {PROPS} SELECT count(*) AS n FROM ({_A} UNION {_B})")
def set_cardinality(spark, d):
    """Through bitmaps: one for each bucket of ids, merged by OR."""
    a, b = _sets(spark, d)
    maps = sets.bitmaps(a).unionByName(sets.bitmaps(b)).groupBy("bucket").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    return maps.agg(F.coalesce(F.sum(F.call_function("bitmap_count", F.col("bits"))), F.lit(0)).cast("long").alias("n"))


@query("set_bitmaps_back", f"WITH {PROPS} {_A} UNION {_B}")
def set_bitmaps_back(spark, d):
    return sets.from_bitmaps(sets.bitmaps(sets.union(*_sets(spark, d))))


# index keys of documents
@query("doc_index_numeric", "SELECT 'idx:part:size:' || lpad(CAST(p_size AS VARCHAR), 20, '0') || ':' || p_partkey AS key, p_partkey AS id FROM part")
def doc_index_numeric(spark, d):
    return documents.numeric_index_entries(T.part_docs(spark, d), "size")


@query("doc_index_deleted", "SELECT 'idx:part:size:' || lpad(CAST(p_size AS VARCHAR), 20, '0') || ':' || p_partkey AS key, p_partkey AS id FROM part WHERE p_size <> 7 UNION ALL SELECT 'idx_str:part:brand:' || p_brand || ':' || p_partkey, p_partkey FROM part WHERE p_size <> 7")
def doc_index_deleted(spark, d):
    """Both indexes after the documents of one size have been deleted."""
    docs = T.part_docs(spark, d)
    entries = documents.numeric_index_entries(docs, "size").unionByName(documents.index_entries(docs, "brand"))
    return documents.without_documents(entries, docs.where(F.col("doc")["size"] == "7"))
