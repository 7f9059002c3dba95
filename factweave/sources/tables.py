"""Sources: Parquet tables, and the key/value log, the facts and the documents that are derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.sources import sizes

#: Object ids: type code * 10**9 + key + 1.
CODES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}
#: Schemas of the star schema's tables; with them no file is opened before an action.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}
PROPS = "obj_id long, field string, vtype string, sval string, nval long, lat double, lon double"
EDGES = "src long, rel string, dst long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def obj_id(kind: str, key) -> Column:
    return (F.lit(CODES[kind] * 10**9 + 1) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


#: The kinds of objects: table, key, and the columns of their text and number fields.
OBJECTS: dict[str, tuple[str, str, dict[str, str], dict[str, str]]] = {
    "customer": ("customer", "c_custkey", {"name": "c_name", "mktsegment": "c_mktsegment"}, {"acctbal_cents": "round(c_acctbal * 100)"}),
    "supplier": ("supplier", "s_suppkey", {"name": "s_name"}, {"acctbal_cents": "round(s_acctbal * 100)"}),
    "part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "ptype": "p_type"}, {"size": "p_size", "retail_cents": "round(p_retailprice * 100)"}),
    "nation": ("nation", "n_nationkey", {"name": "n_name"}, {}),
    "region": ("region", "r_regionkey", {"name": "r_name"}, {}),
    "order": ("orders", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"}, {"total_cents": "round(o_totalprice * 100)"}),
}
_NOWHERE = "CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon"


def _id(kind: str, key: str) -> str:
    return f"CAST({CODES[kind] * 10**9 + 1} + {key} AS BIGINT)"


def _sql(spark: SparkSession, sf_dir: str, text: str, names: set[str]) -> DataFrame:
    """One statement over tables, so it is analysed once however many branches it has."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def facts_of(rows: DataFrame, object_id: Column, strings: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """One row per object and field. Each field is a branch of its own, so a literal field prunes all others."""
    none = lambda kind: F.lit(None).cast(kind)

    def branch(field: str, vtype: str, sval: Column, nval: Column) -> DataFrame:
        return rows.select(object_id.alias("obj_id"), F.lit(field).alias("field"), F.lit(vtype).alias("vtype"), sval.alias("sval"), nval.alias("nval"), none("double").alias("lat"), none("double").alias("lon"))

    parts = [branch(f, "string", c.cast("string"), none("long")).where("sval is not null") for f, c in strings.items()]
    parts += [branch(f, "numeric", none("string"), c.cast("long")).where("nval is not null") for f, c in numbers.items()]
    return reduce(DataFrame.unionByName, parts)


def props(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(OBJECTS)) -> DataFrame:
    """Properties of the star schema's objects. Each field is a branch of its own, so a literal field prunes all others."""
    out = []
    for kind in kinds:
        name, key, strings, numbers = OBJECTS[kind]
        head = f"SELECT {_id(kind, key)} AS obj_id"
        out += [f"{head}, '{f}' AS field, 'string' AS vtype, {c} AS sval, CAST(NULL AS BIGINT) AS nval, {_NOWHERE} FROM {{{name}}} WHERE {c} IS NOT NULL" for f, c in {"type": f"'{kind}'", **strings}.items()]
        out += [f"{head}, '{f}', 'numeric', CAST(NULL AS STRING), CAST({c} AS BIGINT), {_NOWHERE} FROM {{{name}}} WHERE {c} IS NOT NULL" for f, c in numbers.items()]
    return _sql(spark, sf_dir, " UNION ALL ".join(out), {OBJECTS[k][0] for k in kinds})


def props_by_object(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(OBJECTS)) -> DataFrame:
    """The same facts with one scan for each kind of object, for queries that want all fields of some objects."""
    out = []
    for kind in kinds:
        name, key, strings, numbers = OBJECTS[kind]
        fact = "named_struct('field', '{}', 'vtype', '{}', 'sval', CAST({} AS STRING), 'nval', CAST({} AS BIGINT))"
        found = [fact.format(f, "string", c, "NULL") for f, c in {"type": f"'{kind}'", **strings}.items()] + [fact.format(f, "numeric", "NULL", c) for f, c in numbers.items()]
        out.append(f"SELECT obj_id, f.field, f.vtype, f.sval, f.nval, {_NOWHERE} FROM (SELECT {_id(kind, key)} AS obj_id, explode(array({', '.join(found)})) AS f FROM {{{name}}})")
    return _sql(spark, sf_dir, " UNION ALL ".join(out), {OBJECTS[k][0] for k in kinds}).where("sval IS NOT NULL OR nval IS NOT NULL")


def geo_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of suppliers, made up from their keys."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        obj_id("supplier", "s_suppkey").alias("obj_id"), F.lit("place").alias("field"), F.lit("geo").alias("vtype"), F.lit(None).cast("string").alias("sval"), F.lit(None).cast("long").alias("nval"), (k * 37 % 180 - 89.5).cast("double").alias("lat"), (k * 91 % 360 - 179.5).cast("double").alias("lon")
    ).withColumn("nval", S.geohash64("lat", "lon"))


def _distinct(src: str, dst: str, name: str) -> str:
    """Pairs that few rows share: they are dealt out, ``[name]`` ways, before they are compared, so no task holds those of a whole split."""
    return f"SELECT DISTINCT src, dst FROM (SELECT /*+ REPARTITION([{name}], src, dst) */ {src} AS src, {dst} AS dst FROM {{{name}}})"


#: Relationships, and the statements that give them. KNOWS is made up: n is the number of customers.
RELATIONSHIPS = {
    "IN_NATION": (f"SELECT {_id('customer', 'c_custkey')} AS src, {_id('nation', 'c_nationkey')} AS dst FROM {{customer}} UNION ALL SELECT {_id('supplier', 's_suppkey')}, {_id('nation', 's_nationkey')} FROM {{supplier}}", {"customer", "supplier"}),
    "IN_REGION": (f"SELECT {_id('nation', 'n_nationkey')} AS src, {_id('region', 'n_regionkey')} AS dst FROM {{nation}}", {"nation"}),
    "PLACED": (f"SELECT {_id('customer', 'o_custkey')} AS src, {_id('order', 'o_orderkey')} AS dst FROM {{orders}}", {"orders"}),
    "CONTAINS": (_distinct(_id("order", "l_orderkey"), _id("part", "l_partkey"), "lineitem"), {"lineitem"}),
    "SUPPLIES": (_distinct(_id("supplier", "l_suppkey"), _id("part", "l_partkey"), "lineitem"), {"lineitem"}),
    "KNOWS": (
        f"SELECT {_id('customer', 'c')} AS src, {_id('customer', 'd')} AS dst FROM (SELECT c_custkey AS c, explode(array_distinct(array((c_custkey + 1) % n, (c_custkey + 2) % n, (c_custkey + 7) % n, (c_custkey * 7 + 1) % n, if(c_custkey % 5 = 0, (c_custkey + n - 1) % n, NULL)))) AS d FROM (SELECT c_custkey, (SELECT count(*) FROM {{customer}}) AS n FROM {{customer}})) WHERE d IS NOT NULL AND c <> d",
        {"customer"},
    ),
}


def edges(spark: SparkSession, sf_dir: str, rels: tuple[str, ...] = tuple(RELATIONSHIPS)) -> DataFrame:
    """Directed relationships of the star schema, each once. Each type is a branch of its own."""
    text = " UNION ALL ".join(f"SELECT src, '{r}' AS rel, dst FROM ({RELATIONSHIPS[r][0]})" for r in rels)
    names = set().union(*(RELATIONSHIPS[r][1] for r in rels))
    for name in names:
        if f"[{name}]" in text:
            text = text.replace(f"[{name}]", str(sizes.parts(table(spark, sf_dir, name))))
    return _sql(spark, sf_dir, text, names)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version log of the collection ``orders``: one version of each order's status."""
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("collection"), F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(1).cast("long").alias("txn_id"), F.col("o_orderkey").alias("seq"), F.lit(False).alias("is_deleted"), F.lit(0).alias("generation")
    )


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version log of the collection ``users``: an event is a version, an error a tombstone; generations by turns."""
    return table(spark, sf_dir, "events").select(
        F.lit("users").alias("collection"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), F.col("event_id").alias("txn_id"), F.lit(0).cast("long").alias("seq"), (F.col("event_type") == "error").alias("is_deleted"), (F.col("event_id") % 2).cast("int").alias("generation")
    )


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemaless documents of parts: ``ns``, ``id`` and a map of texts."""
    return table(spark, sf_dir, "part").select(
        F.lit("part").alias("ns"), F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("doc")
    )
