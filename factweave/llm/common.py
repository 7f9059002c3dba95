"""What the corpus operators share: scratch space, Arrow text access and vectorised byte hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.scratch import shared_dir


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer files, of data that are small beside their input: four for each core, or an eighth of the shuffle partitions."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def checkpoint(df: DataFrame, few: bool = True) -> DataFrame:
    """``df`` computed once and kept, with its lineage cut, in the shared scratch folder. For results that are small beside their input.

    ``few``: in few files. Not where a function of ``df`` asks for its partition's number, which several would then share.
    """
    shared_dir(df.sparkSession)
    return (few_files(df) if few else df).checkpoint()


def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` in n partitions by columns, checkpointed so that later steps know it and don't deal it out again.

    It is planned without adaptive execution, whose plans don't tell how they are partitioned.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df.repartition(n, *by), few=False)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: Scratch tables that this process has written.
_SCRATCH: list[str] = []


def scratch_tables() -> list[str]:
    """The scratch tables that are there now."""
    return list(_SCRATCH)


def drop_scratch(spark: SparkSession, but: Collection[str] = ()) -> int:
    """Deletes the scratch tables written so far, but for those named, once results that stand on them have been read; how many there were."""
    gone = [at for at in _SCRATCH if at not in but]
    for at in gone:
        _SCRATCH.remove(at)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def written(df: DataFrame, few: bool = True) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: compact, and safe from lost executors.

    ``few``: in few files, for tables that are small beside their input.
    """
    path = f"{shared_dir(df.sparkSession)}/factweave-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    (few_files(df) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole text column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(spark: SparkSession, n_bytes: int, per_part: int = 8 << 20) -> int:
    """How many pieces hold ``n_bytes`` at ``per_part`` each; never fewer than the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_part), 1)


def let_go(out: pa.Table) -> pa.Table:
    """``out``, once the memory freed on the way to it has gone back to the system: else a worker keeps it for as long as it is reused."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls (null: empty), as one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of ``strings()``, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least), so that temporary arrays stay in cache."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """Polynomial hashes (modulo 2**64, random byte table) of any substrings of a byte array."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 1 << 18)
            step = np.full(n + 1, self.base, np.uint64)
            step[0] = 1
            self.powers = np.cumprod(step, dtype=np.uint64)
            step[1:] = self.back
            self.inverse = np.cumprod(step, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums from which ``between`` takes substrings."""
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:n], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]

    def grams(self, sums: np.ndarray, q: int) -> np.ndarray:
        """The hash of every q-byte string; empty where the data are shorter."""
        n = len(sums) - q
        return (sums[q:] - sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


WORD_HASH = RollingHash(11)

#: Bytes of words: ASCII letters and digits, and all of what is beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; runs end with their row. Offsets start at 0 in data."""
    n = len(data)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n lower-cased words of a row; of all its words where it has fewer than n."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = mix(WORD_HASH.between(WORD_HASH.prefix(data), starts, ends))
    count = len(one)
    if count >= n:
        out = one[: count - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + one[k : count - n + 1 + k]
        whole = row[: count - n + 1] == row[n - 1 :]
        out, rows = mix(out[whole]), row[: count - n + 1][whole]
    else:
        out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    if len(short := np.flatnonzero((per_row > 0) & (per_row < n))):
        begin = np.searchsorted(row, short)
        extra = np.array([_fold(one[b : b + per_row[r]]) for b, r in zip(begin, short)], np.uint64)
        out, rows = np.concatenate([out, mix(extra)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def _fold(hashes: np.ndarray) -> int:
    x = 0
    for h in hashes.tolist():
        x = (x * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return x


#: Bits of the hashes in token sets.
TOKEN_BITS = 48


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens (48-bit hashes) of each row, sorted by row and token, and where each row's begin."""
    hashes, row = shingles(data, offsets, n)
    rows = len(offsets) - 1
    if rows < 1 << 16:
        both = np.unique((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (hashes >> np.uint64(64 - TOKEN_BITS)))
        row, tokens = (both >> np.uint64(TOKEN_BITS)).astype(np.int64), both & np.uint64((1 << TOKEN_BITS) - 1)
    else:
        pairs = np.unique(np.stack([row.astype(np.uint64), hashes >> np.uint64(64 - TOKEN_BITS)]), axis=1)
        row, tokens = pairs[0].astype(np.int64), pairs[1]
    return tokens, np.searchsorted(row, np.arange(rows + 1))
