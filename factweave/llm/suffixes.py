"""Removal of repeated byte strings by distributed bucket-pointer refinement.

A byte is removed if it lies in a string of ``MATCH`` bytes that also starts in a document with a smaller id. Strings
are compared as they stand in the input, and never across the ends of documents.

Suffixes that agree on their first ``Q`` bytes share an initial bucket, named by a hash of those bytes. A bucket is
refined by sorting on the bucket names of later offsets: a string of 50 bytes is the pair of the names at its start
and Q bytes on. Names so refined are reused for longer strings: a stretch from one start to another, at most Q on, is
the pair of the refined names at its two ends. Only what can still be split goes on to the next level:

1. Every window of MATCH bytes chooses one of its q-grams, the least by name, so equal windows choose alike. Windows
   next to one another that choose the same place form a stretch; its bucket is that q-gram. Buckets of one document
   alone are dropped.
2. Buckets are sorted on the refined names of whole stretches. All windows of a stretch that a smaller id has too
   are repeats. A bucket with one stretch is settled.
3. In buckets with several stretches (at the ends of repeats) the windows of each are sorted on their refined names.

Texts lie in blocks that stay where they are, checkpointed in the shared folder. For each level a block sends the sorted names
that it has, once each with its smallest id, to the task of their range, and gets bits back in the same order; so a name costs
a block one entry, however many documents share it. A block is worked on in parts of ``PART_BYTES``, one after another (a longer
document is a part), so that is what a worker holds; messages are those of the whole block. Names have 80 bits where they decide
on a repeat, and the bytes themselves are not compared: of 10^12 different strings two have one name with a probability of half.

Null texts count as empty. Rows without an id come after all ids. Rows of one id don't count as repeats of each other.
All columns are kept, whatever their names, but for ``text`` itself and the counts that are added. Documents of any
length are read in pieces that overlap, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import RollingHash, checkpoint, dealt, let_go, mix, parts_for, strings, table, text_bytes, written

MATCH, Q = 50, 25
CHOICE = MATCH - Q + 1
FIRST, SECOND = RollingHash(41), RollingHash(43)
BLOCK_BYTES, PART_BYTES, PIECE_BYTES = 16 << 20, 2 << 20, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1
_CUT = np.uint64(48)
ANSWER = "block int, level int, range int, counts binary, bits binary, more binary"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _STEP + b)


class Names:
    """Bucket names of the q-grams of a piece, and refined names of its longer strings."""

    def __init__(self, data: np.ndarray):
        self.sums = [(h, h.prefix(data)) for h in (FIRST, SECOND)]

    def initial(self) -> np.ndarray:
        h, sums = self.sums[0]
        return mix(h.grams(sums, Q))

    def _at(self, k: int, start: np.ndarray) -> np.ndarray:
        h, sums = self.sums[k]
        return mix(h.between(sums, start, start + Q))

    def window(self, k: int, start: np.ndarray) -> np.ndarray:
        return _pair(self._at(k, start), self._at(k, start + Q))

    def stretch(self, k: int, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _pair(_pair(self.window(k, start), self.window(k, last)), (last - start).astype(np.uint64))


def stretches(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and chosen q-gram of each stretch. ``ends``: for each byte, where its document ends."""
    n = len(names) - CHOICE + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = np.uint64((1 << max(20, len(names).bit_length())) - 1)
    least = (names & ~low) | (low - np.arange(len(names), dtype=np.uint64))  # of equal names the last
    width = 1
    while 2 * width <= CHOICE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := CHOICE - width:
        least = np.minimum(least[:-rest], least[rest:])
    at = np.flatnonzero(np.arange(MATCH, n + MATCH) <= ends[:n])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    chosen = (low - (least[at] & low)).astype(np.int64)
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(chosen) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.append(new - 1, len(at) - 1)
    return at[first], at[last], chosen[first]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def parts(rows: pa.Table) -> list[pa.Table]:
    """A block's rows in an order of their own, cut into parts; one part without rows if there are none."""
    if not rows.num_rows:
        return [rows]
    at, packed = rows.column("at").to_pylist(), rows.column("packed").to_pylist()
    order = sorted(range(len(at)), key=lambda i: (at[i], packed[i]))
    out, size = [[]], 0
    for i in order:
        own = zstandard.frame_content_size(packed[i])
        if out[-1] and size + own > PART_BYTES:
            out.append([])
            size = 0
        out[-1].append(i)
        size += own
    return [rows.take(pa.array(own)) for own in out]


#: What came back from a range: its number, how many names each part had sent, and bits of all in turn.
Answer = tuple[int, bytes, bytes]


class Block:
    """The texts of a part of a block (the one of that number) and what it knows of its stretches."""

    def __init__(self, rows: pa.Table, n_ranges: int, part: int = 0):
        self.part = part
        unpack = zstandard.ZstdDecompressor().decompress
        packed = rows.column("packed").to_pylist()
        texts = [unpack(z) for z in packed]
        order = sorted(range(len(texts)), key=lambda i: (rows_at[i], packed[i])) if (rows_at := rows.column("at").to_pylist()) else []
        self.order, self.n_ranges = order, n_ranges
        self.ids = np.array([rows_at[i] for i in order], np.int64)
        texts = [texts[i] for i in order]
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Begin and end of each piece of the data, and where the document of each of its bytes ends (from its begin on)."""
        lo, n = 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + PIECE_BYTES, "right")) - 1)
            begin, end = int(self.offsets[lo]), int(self.offsets[hi])
            for at in range(begin, max(end, begin + 1), PIECE_BYTES if hi == lo + 1 else max(end - begin, 1)):
                # the last windows of a piece of a long document reach into the next one
                to = min(end, at + PIECE_BYTES + MATCH - 1) if hi == lo + 1 else end
                yield at, to, np.minimum(np.repeat(self.offsets[lo + 1 : hi + 1], np.diff(self.offsets[lo : hi + 1]))[at - begin : to - begin], to) - at
            lo = hi

    def find(self, whole: bool) -> None:
        """All stretches, by bucket; ``whole``: with their refined names."""
        found: list[list[np.ndarray]] = []
        for begin, end, ends in self.pieces():
            names = Names(self.data[begin:end])
            initial = names.initial()
            first, last, chosen = stretches(initial, ends)
            # the least of many names is small; mixed anew, buckets spread evenly over ranges
            found.append([first + begin, last + begin, mix(initial[chosen] + _STEP), *([names.stretch(0, first, last), names.stretch(1, first, last) >> _CUT] if whole else [])])
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
        self.first, self.last, self.bucket = columns[:3]
        self.name = columns[3:5]
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1

    def buckets(self) -> np.ndarray:
        """The sorted buckets, once each."""
        self.sorted, self.at = np.unique(self.bucket, return_inverse=True)
        return self.sorted

    def ranges(self, sorted_names: np.ndarray) -> np.ndarray:
        return range_of(sorted_names, self.n_ranges)

    def spread(self, sorted_names: np.ndarray, answers: list[Answer]) -> np.ndarray:
        """Bits that came back, in the order of the names that were sent."""
        out = np.zeros(len(sorted_names), bool)
        ranges = self.ranges(sorted_names)
        for r, counts, bits in answers:
            lo, hi = np.searchsorted(ranges, [r, r + 1])
            before = int(np.frombuffer(counts, np.int32)[: self.part].sum())
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=before + hi - lo)[before:].view(bool)
        return out

    def candidates(self, answers: list[Answer]) -> None:
        """Keeps the stretches of buckets that other parts have, or more than one id of this one."""
        shared = self.spread(self.buckets(), answers)
        ids = self.ids[self.doc]
        least, most = np.full(len(shared), _NO_ID), np.full(len(shared), -_NO_ID - 1)
        np.minimum.at(least, self.at, ids)
        np.maximum.at(most, self.at, ids)
        keep = (shared | (least < most))[self.at]
        self.first, self.last, self.bucket, self.doc = (x[keep] for x in (self.first, self.last, self.bucket, self.doc))
        self.name = [x[keep] for x in self.name]
        order = np.lexsort((self.ids[self.doc], self.name[1], self.name[0], self.bucket))
        self.first, self.last, self.bucket, self.doc = (x[order] for x in (self.first, self.last, self.bucket, self.doc))
        self.name = [x[order] for x in self.name]
        new = _groups(self.bucket, *self.name)
        self.head = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.smallest = self.ids[self.doc[self.head]] if len(self.head) else np.zeros(0, np.int64)

    def settle(self, seen: np.ndarray, several: np.ndarray) -> None:
        """Which stretches are repeats, and the windows of those that must be looked at one by one."""
        own = self.ids[self.doc] == self.smallest[self.group]
        self.repeat = ~own | seen[self.group]
        # all places of the smallest id, which may have the stretch more than once
        split = np.flatnonzero(own & (several & ~seen)[self.group])
        count = self.last[split] - self.first[split] + 1
        windows = np.repeat(self.first[split] - np.cumsum(count) + count, count) + np.arange(count.sum())
        windows.sort()
        one, two = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.uint64)
        for begin, end, ends in self.pieces():
            last = end if end == len(self.data) or end in self.offsets else end - MATCH + 1
            lo, hi = np.searchsorted(windows, [begin, last])
            if lo < hi:
                names = Names(self.data[begin:end])
                one[lo:hi] = names.window(0, windows[lo:hi] - begin)
                two[lo:hi] = names.window(1, windows[lo:hi] - begin) >> _CUT
        ids = self.ids[np.searchsorted(self.offsets, windows, "right") - 1]
        order = np.lexsort((ids, two, one))
        self.windows, self.window_ids, self.window_name = windows[order], ids[order], [one[order], two[order]]
        new = _groups(*self.window_name)
        self.window_head, self.window_group = np.flatnonzero(new), np.cumsum(new) - 1

    def removed(self, seen: np.ndarray) -> np.ndarray:
        """True for each byte that goes."""
        own = self.window_ids == (self.window_ids[self.window_head][self.window_group] if len(self.windows) else self.window_ids)
        repeat = self.windows[~own | seen[self.window_group]] if len(self.windows) else self.windows
        begin = np.concatenate([self.first[self.repeat], repeat])
        end = np.concatenate([self.last[self.repeat], repeat]) + MATCH
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > end[:-1]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[begin[new]] = 1
        step[end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end] -= 1
        return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def _thin(x: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of 64-bit words."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]).tobytes()


def _wide(data: bytes, n_bytes: int) -> np.ndarray:
    thin = np.frombuffer(data, np.uint8).reshape(-1, n_bytes)
    out = np.zeros((len(thin), 8), np.uint8)
    out[:, :n_bytes] = thin
    return out.view("<u8").ravel()


ASK = "range int, block int, counts binary, names binary, whole binary, ids binary"
#: Bytes of a bucket's name, and of each half of a whole name, that are sent.
BUCKET, ONE, TWO = 6, 8, 2


def _near(ids: np.ndarray) -> bytes:
    """Ids in as few bytes each as they need above the least."""
    least = int(ids.min())
    above = ids.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
    n_bytes = max(1, -(-int(above.max()).bit_length() // 8))
    return least.to_bytes(8, "little", signed=True) + _thin(above, n_bytes)


def _far(data: bytes, n: int) -> np.ndarray:
    return (_wide(data[8:], (len(data) - 8) // n) + np.frombuffer(data, np.uint64, 1)).view(np.int64)


Sent = tuple[np.ndarray, list[np.ndarray] | None, np.ndarray | None]


def _asked(number: int, n_ranges: int, sent: list[Sent]) -> pa.Table:
    """What a block asks each range: the names, whole names and ids of its parts. Names that are the first half of whole ones aren't sent twice."""
    twice = sent[0][1] is not None and sent[0][0] is sent[0][1][0]
    # the names of each part are sorted, so those of a range are a slice of it
    cuts = [np.searchsorted(range_of(x[0], n_ranges), np.arange(n_ranges + 1)) for x in sent]
    columns: list[list] = [[] for _ in range(6)]
    for r in range(n_ranges):
        at = [slice(c[r], c[r + 1]) for c in cuts]
        counts = np.array([x.stop - x.start for x in at], np.int32)
        if counts.any():
            of = lambda pick: np.concatenate([pick(x)[k] for x, k in zip(sent, at)])
            names = b"" if twice else _thin(of(lambda x: x[0]), BUCKET)
            whole = b"" if sent[0][1] is None else _thin(of(lambda x: x[1][0]), ONE) + _thin(of(lambda x: x[1][1]), TWO)
            ids = b"" if sent[0][2] is None else _near(of(lambda x: x[2]))
            for column, value in zip(columns, (r, number, counts.tobytes(), names, whole, ids)):
                column.append(value)
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["range", "block", "counts", "names", "whole", "ids"])


def range_of(names: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def _answers(right: pa.Table) -> dict[int, list[tuple[int, bytes, bytes, bytes]]]:
    out: dict[int, list] = {1: [], 2: [], 3: []}
    for level, *answer in zip(*(right.column(c).to_pylist() for c in ("level", "range", "counts", "bits", "more"))):
        out[level].append(tuple(answer))
    return out


def _known(rows: pa.Table, got: dict[int, list], n_ranges: int, level: int, part: int) -> Block:
    """A part of a block with all that the answers up to a level tell it."""
    block = Block(rows, n_ranges, part)
    block.find(True)
    block.candidates([x[:3] for x in got[1]])
    if level > 1:
        names = block.bucket[block.head]
        block.settle(block.spread(names, [x[:3] for x in got[2]]), block.spread(names, [(r, counts, more) for r, counts, _, more in got[2]]))
    return block


def _ask(n_ranges: int, level: int) -> Callable:
    """Asks for the buckets of all stretches, then for the stretches that are left, then for the windows."""

    def sent(rows: pa.Table, got: dict[int, list], part: int) -> Sent:
        if level == 1:
            block = Block(rows, n_ranges)
            block.find(False)
            return block.buckets(), None, None
        block = _known(rows, got, n_ranges, level - 1, part)
        if level == 2:
            return block.bucket[block.head], [x[block.head] for x in block.name], block.smallest
        name = [x[block.window_head] for x in block.window_name]
        return name[0], name, block.window_ids[block.window_head]

    def ask(rows: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not rows.num_rows:
            return _asked(0, n_ranges, [(np.zeros(0, np.uint64), None, None)])
        got = {} if right is None else _answers(right)
        return _asked(rows.column("block")[0].as_py(), n_ranges, [sent(own, got, k) for k, own in enumerate(parts(rows))])

    return ask


def _answer(level: int) -> Callable[[pa.Table], pa.Table]:
    """Sorts the names of a range from all blocks."""

    def answer(asked: pa.Table) -> pa.Table:
        blocks = asked.column("block").to_pylist()
        bucket = _wide(b"".join(asked.column("names").to_pylist()), BUCKET)
        whole = asked.column("whole").to_pylist()
        count = [len(x) // BUCKET for x in asked.column("names").to_pylist()] if level == 1 else [len(w) // (ONE + TWO) for w in whole]
        at = np.cumsum([0, *count])
        if level > 1:
            one = np.concatenate([_wide(w[: ONE * n], ONE) for w, n in zip(whole, count)])
            two = np.concatenate([_wide(w[ONE * n :], TWO) for w, n in zip(whole, count)])
            ids = np.concatenate([_far(x, n) for x, n in zip(asked.column("ids").to_pylist(), count)])
            bucket = bucket if level == 2 else one
        first = np.zeros(len(bucket), bool)
        second = np.zeros(len(bucket), bool)
        if level == 1:
            order = np.argsort(bucket, kind="stable")
            new = _groups(bucket[order])
            first[order] = ~(new & np.append(new[1:], True))  # other blocks have it too
        else:
            order = np.lexsort((ids, two, one, bucket))
            new = _groups(bucket[order], one[order], two[order])
            head, group = np.flatnonzero(new), np.cumsum(new) - 1
            first[order] = ids[order] > ids[order][head][group]  # a smaller id has it
            apart = np.cumsum(_groups(bucket[order])) - 1
            second[order] = np.bincount(apart[head], minlength=apart[-1] + 1)[apart] > 1
        counts = asked.column("counts").to_pylist()
        rows = [(b, level, c, np.packbits(first[lo:hi]).tobytes(), np.packbits(second[lo:hi]).tobytes()) for b, c, lo, hi in zip(blocks, counts, at, at[1:]) if first[lo:hi].any() or second[lo:hi].any()]
        columns = list(zip(*rows)) or [()] * 5
        r = asked.column("range")[0].as_py()
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([r] * len(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["block", "level", "range", "counts", "bits", "more"])

    return answer


#: What can be had of the bytes that are left, and its type.
KEPT = {"kept": "binary", "kept_sha256": "string", "text": "string"}


def whole_characters(data: np.ndarray, gone: np.ndarray) -> str:
    """What is left of UTF-8 without the characters that lost some of their bytes."""
    if not gone.any():
        return data.tobytes().decode()
    number = np.cumsum((data & 0xC0) != 0x80) - 1
    cut = np.zeros(number[-1] + 1, bool)
    cut[number[gone]] = True
    return data[~cut[number]].tobytes().decode()


def _results(n_ranges: int, names: list[str], kind: str) -> Callable:
    counts = ["n_bytes", "n_removed", "n_spans"]
    of = {"kept": lambda data, gone: data[~gone].tobytes(), "kept_sha256": lambda data, gone: hashlib.sha256(data[~gone].tobytes()).hexdigest(), "text": whole_characters}[kind]

    def of_part(rows: pa.Table, got: dict[int, list], part: int) -> pa.Table:
        rest = rows.column("rest").combine_chunks()
        rest = pa.concat_arrays(rest.chunks) if isinstance(rest, pa.ChunkedArray) else rest
        columns = dict(zip([f.name for f in rest.type], rest.flatten()))
        if not rows.num_rows:
            block, gone = Block(rows, n_ranges), np.zeros(0, bool)
        else:
            block = _known(rows, got, n_ranges, 2, part)
            heads = block.window_name[0][block.window_head]
            gone = block.removed(block.spread(heads, [x[:3] for x in got[3]]))
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for lo, hi in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            own = gone[lo:hi]
            n_bytes.append(hi - lo)
            n_removed.append(int(own.sum()))
            n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            kept.append(of(block.data[lo:hi], own))
        index = pa.array(block.order, pa.int64())
        tail = pa.array(kept, pa.binary() if kind == "kept" else pa.string())
        return pa.table([*(columns[c].take(index) for c in names), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), tail], names=[*names, *counts, kind])

    def results(rows: pa.Table, right: pa.Table) -> pa.Table:
        got = _answers(right)
        return pa.concat_tables([of_part(own, got, k) for k, own in enumerate(parts(rows))])

    return results


def without_repeats(docs: DataFrame, kind: str = "kept") -> DataFrame:
    """``docs`` without ``text``, but with ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs) and what is left.

    ``kind``: ``kept`` (the bytes), ``kept_sha256`` (their digest), or ``text`` (the characters that kept all their bytes).
    """
    if kind not in KEPT:
        raise ValueError(f"kind must be one of {', '.join(KEPT)}")
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in {"n_bytes", "n_removed", "n_spans", *KEPT}]
    n = parts_for(spark, text_bytes(docs), BLOCK_BYTES)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("at"), F.struct(*names).alias("rest"), "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([pack(t.as_buffer()) for t in strings(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "at", "rest")), z], ["block", "at", "rest", "packed"])

    # no level deals the texts out again
    blocks = dealt(rows.mapInArrow(packed, rows.drop("text").withColumn("packed", F.lit(None).cast("binary")).schema), n, "block")

    def answered(asked: DataFrame, level: int) -> DataFrame:
        return checkpoint(asked.repartition(n, "range").groupBy("range").applyInArrow(lambda rows: let_go(_answer(level)(rows)), ANSWER), few=False)

    def with_answers(known: DataFrame, f: Callable, schema) -> DataFrame:
        return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda rows, right: let_go(f(rows, right)), schema)

    light = blocks.select("block", "at", "packed")
    known = answered(light.groupBy("block").applyInArrow(lambda rows: let_go(_ask(n, 1)(rows)), ASK), 1)
    for level in (2, 3):
        known = known.unionByName(answered(with_answers(known, _ask(n, level), ASK), level))
    schema = docs.select(*names).withColumns({**{c: F.lit(0).cast("long") for c in ("n_bytes", "n_removed", "n_spans")}, kind: F.lit(None).cast(KEPT[kind])}).schema
    return written(with_answers(known, _results(n, names, kind), schema), few=False)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left as ``text``, and the counts. Of characters that lost some of their bytes the rest goes too."""
    names = docs.columns
    return without_repeats(docs, "text").select(*names, *(c for c in ("n_bytes", "n_removed", "n_spans") if c not in names))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "kept_sha256")


#: Texts are cut into chunks before strings are taken of them, so each is taken of a short text; only strings that occur in two
#: documents, and bytes of documents that hold a later one, are looked at one by one.
CHUNK = 1000
ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), cut AS (
  SELECT doc_id, o, substr(x, CAST(2 * o + 1 AS BIGINT), {2 * (CHUNK + MATCH - 1)}) AS part FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, {CHUNK})) AS o FROM docs)
), strings AS (
  SELECT doc_id, o + i AS i, substr(part, CAST(2 * i + 1 AS BIGINT), {2 * MATCH}) AS s FROM (SELECT doc_id, o, part, unnest(range(least({CHUNK}, len(part) // 2 - {MATCH - 1}))) AS i FROM cut WHERE len(part) >= {2 * MATCH})
), hashed AS MATERIALIZED (
  SELECT doc_id, i, hash(s) AS h, s FROM strings
), often AS (
  SELECT h FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)
), met AS MATERIALIZED (
  SELECT doc_id, i, s FROM hashed WHERE h IN (SELECT h FROM often)
), first AS (
  SELECT s, min(doc_id) AS doc_id FROM met GROUP BY s
), starts AS (
  SELECT a.doc_id, a.i FROM met AS a JOIN first AS f ON a.s = f.s WHERE f.doc_id < a.doc_id
), runs AS (
  SELECT doc_id, min(i) AS begin, max(i) + {MATCH} AS after FROM (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MATCH} THEN 0 ELSE 1 END AS opens FROM starts)
  ) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, after AS begin, lead(begin) OVER (PARTITION BY doc_id ORDER BY begin) AS end_ FROM runs
  UNION ALL SELECT doc_id, 0, min(begin) FROM runs GROUP BY doc_id
), texts AS (
  SELECT k.doc_id, string_agg(substr(d.x, CAST(2 * k.begin + 1 AS BIGINT), CAST(2 * (coalesce(k.end_, len(d.x) // 2) - k.begin) AS BIGINT)), '' ORDER BY k.begin) AS kept FROM kept AS k JOIN docs AS d ON k.doc_id = d.doc_id GROUP BY k.doc_id
), counts AS (
  SELECT doc_id, CAST(sum(after - begin) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.kept, d.x))) AS kept_sha256
FROM docs AS d LEFT JOIN counts AS c ON d.doc_id = c.doc_id LEFT JOIN texts AS t ON d.doc_id = t.doc_id
"""
