"""Column functions: ordered geohashes, name hashes, sortable keys, packed numbers and text documents.

All are expressions of built-in functions, so they stay in the JVM. Null arguments give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flips the sign bit: unsigned order becomes the signed order of a long.
SIGN = -(1 << 63)
METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6_371_008.8


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def geohash64(lat, lon, precision: int = 64) -> Column:
    """Interleaved bits of the cell of a point, longitude first, as a long that holds the unsigned number's bits.

    A bit is 1 if the value lies strictly above the middle of its interval. ``precision``: 1 to 64 bits, high ones first.
    """
    lat, lon = _column(lat).cast("double"), _column(lon).cast("double")
    start = F.struct(F.lit(-90.0).alias("a"), F.lit(90.0).alias("b"), F.lit(-180.0).alias("c"), F.lit(180.0).alias("d"), F.lit(0).cast("long").alias("h"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        middle = F.when(even, (s["c"] + s["d"]) / 2).otherwise((s["a"] + s["b"]) / 2)
        up = F.when(even, lon > middle).otherwise(lat > middle)
        return F.struct(
            F.when(~even & up, middle).otherwise(s["a"]).alias("a"),
            F.when(~even & ~up, middle).otherwise(s["b"]).alias("b"),
            F.when(even & up, middle).otherwise(s["c"]).alias("c"),
            F.when(even & ~up, middle).otherwise(s["d"]).alias("d"),
            F.shiftleft(s["h"], 1).bitwiseOR(F.when(up, 1).otherwise(0).cast("long")).alias("h"),
        )

    found = F.aggregate(F.sequence(F.lit(0), F.lit(precision - 1)), start, step, lambda s: s["h"])
    return F.when(lat.isNotNull() & lon.isNotNull(), found)


def geohash_order(geohash: Column) -> Column:
    """A long whose signed order is the unsigned order of geohashes."""
    return _column(geohash).bitwiseXOR(F.lit(SIGN))


def unsigned(value: Column) -> Column:
    """The unsigned reading of a long, as DECIMAL(20, 0)."""
    value = _column(value)
    wide = value.cast("decimal(20,0)")
    return F.when(value >= 0, wide).otherwise((wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)"))


def geohash_decode(geohash, precision: int = 64) -> Column:
    """The middle of a cell: a struct of ``lat`` and ``lon``."""
    geohash = _column(geohash)
    start = F.struct(F.lit(-90.0).alias("a"), F.lit(90.0).alias("b"), F.lit(-180.0).alias("c"), F.lit(180.0).alias("d"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        up = F.call_function("getbit", geohash, F.lit(precision - 1) - k) == 1
        middle = F.when(even, (s["c"] + s["d"]) / 2).otherwise((s["a"] + s["b"]) / 2)
        return F.struct(
            F.when(~even & up, middle).otherwise(s["a"]).alias("a"),
            F.when(~even & ~up, middle).otherwise(s["b"]).alias("b"),
            F.when(even & up, middle).otherwise(s["c"]).alias("c"),
            F.when(even & ~up, middle).otherwise(s["d"]).alias("d"),
        )

    found = F.aggregate(F.sequence(F.lit(0), F.lit(precision - 1)), start, step, lambda s: F.struct(((s["a"] + s["b"]) / 2).alias("lat"), ((s["c"] + s["d"]) / 2).alias("lon")))
    return F.when(geohash.isNotNull(), found)


def degrees_box(lat, lon, metres) -> tuple[Column, Column, Column, Column]:
    """South, north, west and east of a square around a point, in degrees."""
    lat, lon, metres = _column(lat).cast("double"), _column(lon).cast("double"), _column(metres).cast("double")
    high = metres / METRES_PER_DEGREE
    wide = metres / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return lat - high, lat + high, lon - wide, lon + wide


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two points on a sphere."""
    a, b, c, d = (F.radians(_column(x).cast("double")) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def fnv1a32(text) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a string."""
    text = _column(text)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda k: F.conv(F.hex(F.substring(text.cast("binary"), k, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(text) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    found = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(text.isNotNull(), found)


def sortable_key(path, number) -> Column:
    """``path:`` and the number in 20 digits, so text order is number order."""
    return F.concat(_column(path), F.lit(":"), F.lpad(_column(number).cast("string"), 20, "0"))


def path_key(path, value) -> Column:
    """A path and a value with a zero byte between them."""
    return F.concat(_column(path), F.lit("\0"), _column(value).cast("string"))


def path_of(key) -> Column:
    return F.substring_index(_column(key), "\0", 1)


def value_of(key) -> Column:
    key = _column(key)
    at = F.instr(key, "\0")
    return F.when(at > 0, F.substring(key, at + 1, F.length(key)))


def to_number(text) -> Column:
    """The number that a whole text of digits gives, else null."""
    text = _column(text)
    return F.when(text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("99999999999999999999")).cast("decimal(20,0)"))


def z_order3(a, b, c) -> Column:
    """Three 16-bit numbers spread at a stride of two bits and combined; different triples may give one number."""

    def spread(x: Column) -> Column:
        x = _column(x).cast("long").bitwiseAND(F.lit(0xFFFF))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(a), 2).bitwiseOR(F.shiftleft(spread(b), 1)).bitwiseOR(spread(c))


def bit_pack(country, age, tier) -> Column:
    """Country, age and tier in one number that sorts in this order."""
    return F.shiftleft(_column(country).cast("long"), 48).bitwiseOR(F.shiftleft(_column(age).cast("long"), 40)).bitwiseOR(F.shiftleft(_column(tier).cast("long"), 38))


def doc_field(doc, name: str) -> Column:
    """The value of the first ``name:value`` of a text document with ``|`` between its fields; values may hold ``:``."""
    first = F.try_element_at(F.filter(F.split(_column(doc), r"\|"), lambda x: x.startswith(name + ":")), F.lit(1))
    return F.substring(first, len(name) + 2, 1 << 30)


def doc_map(doc) -> Column:
    """All fields of a text document as a map; of a repeated name the first value stands."""
    fields = F.filter(F.split(_column(doc), r"\|"), lambda x: x.contains(":"))
    name = lambda x: F.substring_index(x, ":", 1)
    firsts = F.filter(fields, lambda x, i: F.array_position(F.transform(fields, name), name(x)) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(name(x), F.substring(x, F.length(name(x)) + 2, F.length(x)))))


def doc_text(**fields) -> Column:
    """A text document of the given columns, in order; null fields are left out."""
    return F.concat_ws("|", *(F.concat(F.lit(k + ":"), _column(v).cast("string")) for k, v in fields.items()))
