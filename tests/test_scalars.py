from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factweave.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(
    ("lat", "lon", "unsigned"),
    [(37.422, -122.084, 5589826863130677144), (37.334, -122.009, 5589824623460035215), (37.755, -122.452, 5589509901792250110), (51.5, 0.1, 15006283526354335337)],
)
def test_geohash(spark, lat, lon, unsigned):
    row = one(spark, h=S.geohash64(F.lit(lat), F.lit(lon)), u=S.unsigned(S.geohash64(F.lit(lat), F.lit(lon))), d=S.geohash_decode(S.geohash64(F.lit(lat), F.lit(lon))))
    assert row["u"] == Decimal(unsigned)
    assert row["h"] % (1 << 64) == unsigned
    assert row["d"]["lat"] == pytest.approx(lat, abs=1e-6) and row["d"]["lon"] == pytest.approx(lon, abs=1e-6)


def test_geohash_order_is_unsigned(spark):
    points = [(-10.0, -170.0), (51.5, 0.1), (37.4, -122.0), (80.0, 179.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").select(S.geohash_order(S.geohash64("lat", "lon")).alias("o"), S.unsigned(S.geohash64("lat", "lon")).alias("u")).collect()
    assert sorted(rows, key=lambda r: r["o"]) == sorted(rows, key=lambda r: r["u"])


def test_geohash_of_null(spark):
    assert one(spark, h=S.geohash64(F.lit(None), F.lit(1.0)))["h"] is None


@pytest.mark.parametrize(("text", "value"), [("name", 2369371622), ("city", 230981954), ("FOLLOWS", 3474413785), ("London", 3842539327), ("User_100", 1593554914), ("", 2166136261), (None, None)])
def test_fnv1a32(spark, text, value):
    assert one(spark, h=S.fnv1a32(F.lit(text).cast("string")))["h"] == value


def test_packed_numbers(spark):
    row = one(spark, a=S.z_order3(F.lit(1), F.lit(0), F.lit(0)), b=S.z_order3(F.lit(0), F.lit(0), F.lit(2)), c=S.z_order3(F.lit(1), F.lit(2), F.lit(3)), p=S.bit_pack(F.lit(44), F.lit(30), F.lit(1)))
    assert (row["a"], row["b"], row["c"], row["p"]) == (4, 4, 13, 12418159202009088)


def test_keys(spark):
    row = one(spark, k=S.sortable_key(F.lit("idx:user"), F.lit(42)), p=S.path_of(S.path_key(F.lit("a"), F.lit("b"))), v=S.value_of(S.path_key(F.lit("a"), F.lit("b"))))
    assert (row["k"], row["p"], row["v"]) == ("idx:user:00000000000000000042", "a", "b")


def test_documents(spark):
    doc = F.lit("id:1|name:a:b|name:c|odd")
    row = one(spark, i=S.doc_field(doc, "id"), n=S.doc_field(doc, "name"), x=S.doc_field(doc, "x"), m=S.doc_map(doc), t=S.doc_text(id=F.lit(1), none=F.lit(None), name=F.lit("x")))
    assert (row["i"], row["n"], row["x"], row["t"]) == ("1", "a:b", None, "id:1|name:x")
    assert row["m"] == {"id": "1", "name": "a:b"}


@pytest.mark.parametrize(("text", "value"), [("42", 42), ("18446744073709551615", 18446744073709551615), ("-1", None), ("1.5", None), ("", None), ("x", None)])
def test_to_number(spark, text, value):
    assert one(spark, n=S.to_number(F.lit(text)))["n"] == (None if value is None else Decimal(value))
