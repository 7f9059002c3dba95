"""Quality scores: histogram gradient-boosted trees over statistics of whole texts.

The statistics are counted with numpy over the bytes of whole Arrow batches. Trees are fitted on the driver on a
bounded sample of labelled documents (``SAMPLE``, the smallest hashes of their ids), then flattened into arrays of
features, limits and leaves that executors walk for all rows and trees at once.

Null and empty texts have all statistics 0 and are scored like any others. Labels that are null count as missing; a
document with several labels has the one of their majority (a tie: 1). Without any labelled row every score is 0.5.
Rows stand for themselves: repeated rows and null ids are scored. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import WORD_HASH, mix, raw, runs, strings, table, words

#: Labelled rows that the driver fits on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 1.0
THRESHOLD = 0.3
#: A document is held out when the CRC-32 of its id, as text, has this remainder 0.
FOLDS = 5

KINDS = {"space": b" \t\r", "line": b"\n", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "stop": b".,;:?'\"()-", "bang": b"!", "mark": b"#$%&*@^~+=", "bar": b"|<>{}[]\\/_`", "beyond": bytes(range(128, 256))}
FEATURES = ["log_bytes", "log_words", *KINDS, "word_length", "distinct", "repeated", "commonest", "words_per_line", "capitals", "long_words", "short_words"]
_KIND = np.full(256, len(KINDS), np.uint8)
for _k, _chars in enumerate(KINDS.values()):
    _KIND[list(_chars)] = _k
_INK = np.ones(256, bool)
_INK[[*b" \t\r\n"]] = False


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, m = len(offsets) - 1, len(KINDS) + 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    counts = np.bincount(rows * m + _KIND[data], minlength=n * m).reshape(n, m)
    out[:, 0] = np.log1p(size)
    out[:, 2 : 2 + len(KINDS)] = counts[:, : len(KINDS)] / np.maximum(size, 1)[:, None]
    starts, ends, row = words(data, offsets, _INK)
    if not len(starts):
        return out
    per = np.bincount(row, minlength=n)
    some = np.maximum(per, 1)
    length = ends - starts
    hashes = mix(WORD_HASH.between(WORD_HASH.prefix(data), starts, ends))
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[at], np.diff([*at, len(h)]))
    first = data[starts]
    k = 2 + len(KINDS)
    out[:, 1] = np.log1p(per)
    out[:, k] = np.bincount(row, length, n) / some
    out[:, k + 1] = np.bincount(r[at], minlength=n) / some
    out[:, k + 2] = np.bincount(row, again, n) / some
    out[:, k + 3] = most / some
    out[:, k + 4] = per / (1 + counts[:, list(KINDS).index("line")])
    out[:, k + 5] = np.bincount(row, (first >= 65) & (first <= 90), n) / some
    out[:, k + 6] = np.bincount(row, length > 12, n) / some
    out[:, k + 7] = np.bincount(row, length <= 1, n) / some
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, offsets = raw(strings(texts))
    out = [_statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in runs(offsets)]
    return np.concatenate([np.zeros((0, len(FEATURES))), *out])


class Trees:
    """Boosted trees of one depth as flat arrays: the children of node i of a tree are 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.limit, self.leaf = base, feature, limit, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        if trees:
            node = np.zeros((len(x), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.limit[tree, node])
            total += self.leaf[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Trees:
    """Logistic loss, Newton leaves, splits from histograms over quantile bins."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y.min() else -4.0)
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    limits = np.full((x.shape[1], bins), np.inf)
    for f, e in enumerate(edges):
        limits[f, : len(e)] = e
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    rows = np.arange(len(y))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(width)
            split = np.full((width, 2), [0, bins - 1])
            for f in range(x.shape[1]):
                key = local * bins + binned[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                cut = gain.argmax(1)
                better = gain[np.arange(width), cut] > best + 1e-9
                best[better] = gain[np.arange(width), cut][better]
                split[better] = np.stack([np.full(width, f), cut], 1)[better]
            features[t, first : first + width] = split[:, 0]
            cuts[t, first : first + width] = limits[split[:, 0], split[:, 1]]
            node = 2 * node + 1 + (x[rows, features[t, node]] > cuts[t, node])
        leaf = node - inner
        leaves[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += leaves[t, leaf]
    return Trees(base, features, cuts, leaves)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            found = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, batch.column("y")], ["doc_id", "x", "y"])

    got = rows.mapInArrow(part, "doc_id long, x array<double>, y double").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy())


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: good quality likelier) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    docs = docs.drop("score", "predicted")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(part, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def is_held_out(doc_id: int) -> bool:
    """The same fold as ``held_out()``, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.withColumn("held_out", held_out()).mapInArrow(part, "doc_id long, held_out boolean, score double, predicted int")
