"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of all hashes.

A shingle is a run of five lower-cased words (all words of a text that has fewer). Sketches of the same fraction can
be merged, and the share of one sketch in another estimates containment however unequal the documents are. A short
text keeps its ``LEAST`` smallest hashes even where fewer lie below the fraction, so a sketch knows all hashes up to a
bound of its own, and two are compared up to the smaller of their bounds. A fingerprint is the sorted hashes, 12
hexadecimal digits each; equal texts have equal ones; a text without words has "".

Null texts count as empty. Rows with a null id are fingerprinted like any others and stand after all ids in the
descending order. Rows with the same id follow one another in the order of their compressed texts, the same in each run; they, and
all rows without an id, are sorted in one task. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import TOKEN_BITS, parts_for, raw, runs, strings, table, text_bytes, token_sets

WORDS, FRACTION, LEAST = 5, 1 / 8, 16
#: The place in the order of rows without an id.
NO_ID = -(1 << 63)
#: Slices are streamed, so larger ones cost no memory; more than this many would cost the driver some.
MOST_SLICES = 20_000
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next", "held_edited", "held_next"))])


def limit_of(fraction: float) -> int:
    return int(fraction * (1 << TOKEN_BITS))


def sketches(texts: pa.Array, fraction: float = FRACTION, n: int = WORDS) -> list[np.ndarray]:
    """The sorted kept hashes of each text."""
    data, offsets = raw(strings(texts))
    limit = np.uint64(limit_of(fraction))
    out = []
    for lo, hi in runs(offsets):
        tokens, begins = token_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
        count = np.diff(begins)
        keep = (tokens < limit) | (np.arange(len(tokens)) - np.repeat(begins[:-1], count) < LEAST)
        kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[begins[1:-1]]
        out += np.split(tokens[keep], kept)
    return out


def as_text(sketch: np.ndarray) -> str:
    return np.ascontiguousarray(sketch.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BITS // 8 :].tobytes().hex()


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents together."""
    both = np.union1d(a, b)
    return both[(both < np.uint64(limit_of(fraction))) | (np.arange(len(both)) < LEAST)]


def _known(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches as far as both know all hashes."""
    limit = limit_of(fraction)

    def bound(x: np.ndarray) -> int:
        if len(x) < LEAST:
            return 1 << TOKEN_BITS
        return max(limit, int(x[-1]) + 1)

    least = np.uint64(min(bound(a), bound(b)))
    return a[: np.searchsorted(a, least)], b[: np.searchsorted(b, least)]


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """The share of the smaller sketch in the other; two empty ones: 1; 0 where what both know is empty in one."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _known(a, b, fraction)
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def jaccard(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated resemblance of two sketches; two empty ones: 1."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _known(a, b, fraction)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def fingerprint(docs: DataFrame, fraction: float = FRACTION, n: int = WORDS) -> DataFrame:
    """``docs`` with ``sketch`` (array of long), the kept hashes of each text."""
    docs = docs.drop("sketch")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column("text"), fraction, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], [*batch.schema.names, "sketch"])

    return docs.mapInArrow(part, docs.withColumn("sketch", F.lit(None).cast("array<bigint>")).schema)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by as many of the first of the next one (or all)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _slice_of(cuts: list[int], at: np.ndarray) -> np.ndarray:
    """Slices count from the largest ids down."""
    return len(cuts) - np.searchsorted(np.array(cuts, np.int64), at, "right")


def in_slices(docs: DataFrame, n_slices: int) -> DataFrame:
    """Documents dealt to slices of the descending order of ids, compressed; the next slice's head follows each.

    Cuts are approximate quantiles of the ids. The driver knows the cuts and the largest id of each slice, no more.
    Columns: ``slice``, ``own`` (false in rows that only follow), ``at`` (the id, or the least long), ``doc_id``, ``packed``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit(NO_ID)))
    asked = [k / n_slices for k in range(1, n_slices)]
    cuts = sorted({int(c) for c in rows.approxQuantile("at", asked, 1 / (4 * n_slices))}) if asked else []

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            for k, x in zip(_slice_of(cuts, at).tolist(), at.tolist()):
                found[k] = max(x, found.get(k, x))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["slice", "at"])

    heads = rows.select("at").mapInArrow(largest, "slice int, at long").groupBy("slice").agg(F.max("at").alias("at")).orderBy("slice").collect()
    #: The id of a slice's head, to the slice before it (to the last, from the first).
    before = {head["at"]: heads[k - 1]["slice"] for k, head in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.column("at").to_numpy()
            packed = pa.array([pack(t.as_buffer()) for t in strings(batch.column("text"))], pa.binary())
            follow = np.array([i for i, x in enumerate(at.tolist()) if x in before], np.int64)
            index = pa.array(np.concatenate([np.arange(len(at)), follow]))
            slices = np.concatenate([_slice_of(cuts, at), np.array([before[x] for x in at[follow].tolist()], np.int64)])
            own = pa.array(np.arange(len(slices)) < len(at))
            yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), own, *(c.take(index) for c in (batch.column("at"), batch.column("doc_id"), packed))], ["slice", "own", "at", "doc_id", "packed"])

    return rows.mapInArrow(deal, "slice int, own boolean, at long, doc_id long, packed binary")


def against_edits(docs: DataFrame, fraction: float = FRACTION, n: int = WORDS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike its fingerprint is to that and to the next document's."""
    spark = docs.sparkSession
    n_slices = min(MOST_SLICES, parts_for(spark, text_bytes(docs)))
    dealt = in_slices(docs, n_slices).repartition(n_slices, "slice").sortWithinPartitions("slice", F.desc("own"), F.desc("at"), "packed")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        carry: list[tuple] = []
        for batch in batches:
            texts = [unpack(z.as_buffer()).decode() for z in batch.column("packed")]
            rows = carry + list(zip(batch.column("slice").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), texts))
            pairs = [i for i in range(len(rows) - 1) if rows[i][1] and rows[i][0] == rows[i + 1][0]]
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
            of = sketches(pa.array([r[3] for r in rows], pa.large_string()), fraction, n)
            of_changed = sketches(pa.array(changed, pa.large_string()), fraction, n)
            yield pa.RecordBatch.from_pylist(
                [
                    {"doc_id": rows[i][2], "n_chars": len(rows[i][3]), "edited_sha256": hashlib.sha256(t.encode()).hexdigest(), "fingerprint": as_text(of[i]), "edited_fingerprint": as_text(e), "near_edited": jaccard(of[i], e, fraction), "near_next": jaccard(of[i], of[i + 1], fraction), "held_edited": containment(of[i], e, fraction), "held_next": containment(of[i], of[i + 1], fraction)}
                    for i, t, e in zip(pairs, changed, of_changed)
                ],
                schema=OUT,
            )
            carry = rows[-1:]

    return dealt.mapInArrow(part, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double, held_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edits(table(spark, sf_dir, "documents"))
