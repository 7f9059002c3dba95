"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps a fixed number of open windows. A document goes, whole if it is not longer than a window, to
the open window in which it leaves the least room. Where none has room, the fullest is filled up with the head of
the document and emitted, so emitted windows have no padding. What stays open at a partition's end is packed anew
by the same rule, in rounds over groups of partitions; the windows of the last round are closed in lengths that
are powers of two, which need no padding either.

Null texts count as empty; an empty document is its end id alone. Rows stand for themselves: repeated rows and
null ids are packed like any others. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factweave.llm.bpe import byte_characters
from factweave.llm.common import checkpoint, strings, table

VOCABULARY = "word_bpe_49k.json"
WINDOW, OPEN, END, FAN_IN = 4096, 16, 2, 64
#: Words, and pieces of words, that a worker remembers.
REMEMBERED = 600_000
#: Characters of a text that are cut into words at once.
AT_ONCE = 1 << 20
#: Letters from here on may have other normal forms.
LATIN = "\u0250"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Known(dict):
    """A bounded memory: what it lacks it asks for, and it forgets all when full."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, key: str) -> bytes:
        found = self.ask(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = found
        return found


class WordTokenizer:
    """The ids of a text, word by word.

    The tokenizer drops white space and joins nothing across it, and its normaliser maps characters one by one or
    together with marks that follow them, so a text cut at blanks and line ends has the ids of its words in turn.
    Words of printable Latin letters, on which normal forms have no effect, are lowered and cut by the tokenizer's own
    pattern here, and its model is asked for each new piece; any other word goes through the whole tokenizer. Where the
    content of an added token stands in a text, that is its one id, and what is before and after is encoded by itself, as the tokenizer does.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = {str(t): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.added = {text: i.to_bytes(4, "little") for text, i in added.items()}
        self.parts = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.model = self.tokenizer.model
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.cut = regex.compile(split["pattern"]["Regex"]).findall
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.pieces, self.words = _Known(self._piece), _Known(self._word)

    def _piece(self, piece: str) -> bytes:
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown)))

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isprintable() and (word.isascii() or max(word) < LATIN):
            low = word.lower()
            return self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.cut(low)))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(token in text for token in self.added):
            return self._plain(text)
        out, at = [], 0
        for found in self.parts.finditer(text):
            out += (self._plain(text[at : found.start()]), self.added[found[0]])
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        text = text.replace("\n", " ")
        if len(text) <= AT_ONCE:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + AT_ONCE)
            to = len(text) if to < 0 else to
            out += map(self.words.__getitem__, text[at:to].split(" "))
            at = to
        return b"".join(out)


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Window:
    __slots__ = ("free", "pieces")

    def __init__(self, size: int):
        self.free, self.pieces = size, []


class Packer:
    """Open windows of one partition. ``emit`` gets the pieces of each window that is full."""

    def __init__(self, size: int, n_open: int, emit: Callable[[list[tuple]], None]):
        self.size, self.n_open, self.emit = size, n_open, emit
        self.open: list[Window] = []

    def add(self, doc_id: int | None, total: int, start: int, ids: bytes) -> None:
        at, n = 0, len(ids) // 4
        while at < n:
            left = n - at
            best = None
            if left < self.size:
                for w in self.open:
                    if left <= w.free and (best is None or w.free < best.free):
                        best = w
                if best is None and len(self.open) < self.n_open:
                    self.open.append(best := Window(self.size))
                elif best is None:
                    best = min(self.open, key=lambda w: w.free)
            else:
                best = Window(self.size)
            take = min(left, best.free)
            best.pieces.append((doc_id, total, start + at, ids[4 * at : 4 * (at + take)]))
            best.free -= take
            at += take
            if not best.free:
                self.emit(best.pieces)
                if best in self.open:
                    self.open.remove(best)


def _rows(pieces: list[tuple], sequence: int | None, out: list[tuple]) -> None:
    offset = 0
    for doc_id, total, start, ids in pieces:
        n = len(ids) // 4
        out.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset))
        offset += n


def _batch(rows: list[tuple], left: list[tuple]) -> pa.RecordBatch:
    """Rows of sequences, then pieces that are still to be placed, with their ids and their lot."""
    columns = list(zip(*rows)) or [()] * 7
    keep = list(zip(*left)) or [()] * 5
    of = lambda k, more: pa.array([*columns[k], *more], pa.int64())
    none = [None] * len(left)
    return pa.RecordBatch.from_arrays(
        [of(0, keep[0]), of(1, keep[2]), of(2, none), of(3, none), of(4, keep[1]), of(5, none), of(6, none), pa.array([*[None] * len(rows), *keep[4]], pa.int64()), pa.array([*[None] * len(rows), *keep[3]], pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "lot", "ids"],
    )


def _pack_part(path: str, size: int, n_open: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId()
        sequence, rows = lot << 32, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            _rows(pieces, sequence, rows)
            sequence += 1

        packer, coder = Packer(size, n_open, emit), tokenizer(path)
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                ids = coder.encode(t.as_py()) + last
                packer.add(doc_id, len(ids) // 4, 0, ids)
            yield _batch(rows, [])
            rows.clear()
        yield _batch(rows, [(*piece, lot) for w in packer.open for piece in w.pieces])

    return part


def _merge(size: int, n_open: int, first: int, final: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs what a group of lots has left; the final round closes its windows as powers of two."""

    def merge(key: tuple, left: pa.Table) -> pa.Table:
        lot = key[0].as_py()
        sequence, rows = first + (lot << 32), []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            _rows(pieces, sequence, rows)
            sequence += 1

        packer = Packer(size, n_open, emit)
        waiting = sorted(zip(*(left.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids"))), key=lambda p: (-len(p[3]), p[0] is None, p[0] or 0, p[2], p[3]))
        for doc_id, total, start, ids in waiting:
            packer.add(doc_id, total, start, ids)
        if final:
            rest = [piece for w in packer.open for piece in w.pieces]
            while rest:
                room = min(size, 1 << ((sum(len(p[3]) for p in rest) // 4).bit_length() - 1))
                closing, after = [], []
                for doc_id, total, start, ids in rest:
                    take = min(room, len(ids) // 4)
                    room -= take
                    if take:
                        closing.append((doc_id, total, start, ids[: 4 * take]))
                    if 4 * take < len(ids):
                        after.append((doc_id, total, start + take, ids[4 * take :]))
                emit(closing)
                rest = after
            return pa.Table.from_batches([_batch(rows, [])])
        return pa.Table.from_batches([_batch(rows, [(*piece, lot) for w in packer.open for piece in w.pieces])])

    return merge


def pack(docs: DataFrame, path: str | None = None, size: int = WINDOW, n_open: int = OPEN, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. ``size``: a power of two."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    if n_open < 1:
        raise ValueError("n_open must be positive")
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECE + ", lot long, ids binary"
    lots = rows.rdd.getNumPartitions()
    found = checkpoint(rows.mapInArrow(_pack_part(path, size, n_open, end), schema), few=False)
    done = [found.where("sequence_id is not null").drop("lot", "ids")]
    level = 0
    while True:
        level += 1
        final = lots <= FAN_IN
        left = found.where("sequence_id is null").withColumn("lot", F.floor(F.col("lot") / FAN_IN))
        found = checkpoint(left.groupBy("lot").applyInArrow(_merge(size, n_open, level << 56, final), schema))
        done.append(found.where("sequence_id is not null").drop("lot", "ids"))
        if final:
            break
        lots = -(-lots // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
