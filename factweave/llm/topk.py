"""Exact top-k search by inner product over a bit-sliced index.

Each component x becomes the integer floor(256 * x). A block of vectors keeps, for every component, one bitmap over
its rows per bit (a slice). For a query, each slice is shifted by each set bit of the query's component and all are
added with bitmap arithmetic (carry-save adders), which gives the slices of every row's score. Rows are then selected
from the most significant slice downward: while fewer than k rows are certain, a slice's set rows either join them or
narrow those still undecided. Rows that tie on the boundary are resolved exactly, to the smaller ids.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
other lengths than the query's are no candidates for it. A query's own rows (those with its id) are no candidates.
Of repeated query ids the first vector, in the order of its components, is asked. Repeated candidate rows stay
candidates each. Extra columns are not looked at. Scores are exact while integer components and scores fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import checkpoint, table

SCALE, TOP, EVERY = 256, 5, 50
#: Rows of an index block, and the fewest and most queries asked of it at once.
BLOCK_ROWS, FEWEST, MOST = 1 << 16, 128, 4096


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the integer components, of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class BitSlices:
    """The index of one block: row bitmaps of each bit of each component, above the component's least value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.n, self.dims = values.shape
        self.least = values.min(0) if self.n else np.zeros(self.dims, np.int64)
        above = values - self.least
        self.bits = [int(b).bit_length() for b in (above.max(0) if self.n else self.least)]
        self.words = -(-self.n // 64)
        self.all = self._pack(np.ones(self.n, bool))
        self.slices = [[self._pack(above[:, d] >> b & 1 != 0) for b in range(self.bits[d])] for d in range(self.dims)]

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(rows, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score, least significant first, and the constant that must be added to it.

        A negative weight counts the complement of its slices: -w * u is w * (2**b - 1 - u) less w * (2**b - 1).
        """
        constant = int(query @ self.least)
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            if q < 0:
                constant += q * ((1 << self.bits[d]) - 1)
                own = [s ^ self.all for s in self.slices[d]]
            else:
                own = self.slices[d]
            weight, shift = abs(q), 0
            while weight:
                if weight & 1:
                    for b, s in enumerate(own):
                        while len(columns) <= b + shift:
                            columns.append([])
                        columns[b + shift].append(s)
                weight >>= 1
                shift += 1
        total, k = [], 0
        zero = np.zeros(self.words, np.uint64)
        while k < len(columns):
            column = columns[k]
            if len(column) > 1 and k + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # three bits of a weight make one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                columns[k + 1].append((a & b) | (ab & c))
                column.insert(0, ab ^ c)
            if len(column) == 2:
                a, b = column
                columns[k + 1].append(a & b)
                column[:] = [a ^ b]
            total.append(column[0] if column else zero)
            k += 1
        return total, constant

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The (id, score) of the k highest scores, ties to the smaller id."""
        slices, constant = self.scores(query)
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        open_ = self.all.copy()
        if lo < hi:
            own = np.zeros(self.n, bool)
            own[lo:hi] = True
            open_ &= ~self._pack(own)
        sure = np.zeros(self.words, np.uint64)
        need = k
        for s in reversed(slices):
            high = open_ & s
            n = int(np.bitwise_count(high).sum())
            if n > need:
                open_ = high
            elif n:
                sure |= high
                need -= n
                open_ = open_ & ~s
                if not need:
                    break
        found = [*self.rows(sure).tolist(), *(self.rows(open_)[:need].tolist() if need else [])]
        values = [sum((1 << b) for b, s in enumerate(slices) if int(s[r >> 6]) >> (r & 63) & 1) + constant for r in found]
        return sorted(zip(self.ids[found].tolist(), values), key=lambda x: (-x[1], x[0]))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one length, packed: ``n, dims, ids, values`` with at most ``most`` vectors in each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dims: int) -> Iterator[pa.RecordBatch]:
            own = held.pop(dims)
            ids, values = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
            for lo in range(0, len(ids), most):
                n, some = min(most, len(ids) - lo), values[lo : lo + most]
                small = np.int16 if not some.size or -(1 << 15) < int(some.min()) and int(some.max()) < 1 << 15 else np.int64
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids[lo : lo + n].tobytes()], pa.binary()), "data": pa.array([some.astype(small).tobytes()], pa.binary())})

        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), batch.column("v")
            flat, length = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
            begins = np.cumsum(length) - length
            for dims in np.unique(length).tolist():
                rows = np.flatnonzero(length == dims)
                values = flat[begins[rows][:, None] + np.arange(dims)] if dims else np.zeros((len(rows), 0), np.int64)
                held.setdefault(dims, []).append((ids[rows], values))
                if sum(len(i) for i, _ in held[dims]) >= most:
                    yield from out(dims)
        for dims in list(held):
            yield from out(dims)

    return rows.mapInArrow(part, "n long, dims int, ids binary, data binary")


def _values(data: bytes, n: int, dims: int) -> np.ndarray:
    wide = n * dims and len(data) == 8 * n * dims
    return np.frombuffer(data, np.int64 if wide else np.int16).reshape(n, dims).astype(np.int64)


def tasks_of(vectors: DataFrame, queries: DataFrame, block_rows: int, chunk: int | None) -> DataFrame:
    """A row for each packed block of vectors and chunk of queries that meet: those of one length.

    Which meet is settled by their numbers alone; data are joined by block, by chunk and then by both, so no task
    gets more than its blocks and chunks, though all vectors have one length.
    """
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_queries = vectors.count(), once.count()
    n_blocks = -(-n_rows // block_rows) or 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunk = chunk or max(FEWEST, min(MOST, n_queries * n_blocks // (4 * cores)))
    n_chunks = -(-n_queries // chunk) or 1
    blocks = checkpoint(_packed(vectors.repartition(n_blocks), block_rows).withColumn("block", F.monotonically_increasing_id()), few=False)
    chunks = _packed(once.repartition(n_chunks), chunk).withColumn("chunk", F.monotonically_increasing_id())
    chunks = checkpoint(chunks.select("chunk", "dims", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), few=False)
    pairs = checkpoint(blocks.select("block", "dims").join(chunks.select("chunk", "dims"), "dims").select("block", "chunk"))
    asked = pairs.join(chunks.drop("dims"), "chunk")
    return pairs.join(blocks, "block").repartition(max(n_blocks * n_chunks, 1), "block", "chunk").join(asked, ["block", "chunk"])


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, chunk: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors`` for each of ``queries`` (both from ``quantised()``).

    The stated query set is asked of all rows, block by block: blocks and chunks of queries are each one packed row,
    so what is shipped is the vectors once for each chunk, and no pair becomes a row but the k best of a block. Chunks
    (``chunk`` queries) are as large as leaves four tasks for each core, so that blocks are shipped to few of them.
    """
    tasks = tasks_of(vectors, queries, block_rows, chunk)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if held != r["block"]:
                    index = BitSlices(np.frombuffer(r["ids"], np.int64), _values(r["data"], r["n"], r["dims"]))
                    held = r["block"]
                out = []
                for q, v in zip(np.frombuffer(r["q_ids"], np.int64).tolist(), _values(r["q_data"], r["q_n"], r["dims"])):
                    out += [(q, i, s) for i, s in index.top(q, v, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    found = tasks.mapInArrow(part, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM fine
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
