"""Byte-level BPE with a sentencepiece model that is serialised straight from a rank vocabulary.

Every byte is mapped to one printable character, so each vocabulary entry becomes a piece; its score is its
negative rank and its id its rank. Normalisation is the identity. The text is first cut into pre-tokens by a
pattern; each is encoded by itself, and ids are decoded by the inverse mapping.

Null texts count as empty and give no ids. Rows stand for themselves: repeated rows and null ids are kept, and
columns other than the id and the text are not looked at. Very long texts are handled whole, one at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import strings, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers; it forgets all of them when they are more.
REMEMBERED = 400_000
#: Characters of a text that are cut into pre-tokens at once.
AT_ONCE = 1 << 20
#: A single blank between ink: a pre-token always begins there.
_BEGIN = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def byte_characters() -> str:
    """One character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: a varint, a float or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece that it must have comes after them."""
    shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    model = b"".join(_field(1, _field(1, token.decode("latin-1").translate(shown).encode()) + _field(2, -float(rank)) + _field(3, 1)) for token, rank in by_rank)
    model += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return model + _field(2, trainer) + _field(3, normaliser)


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """A long text in parts that have the pre-tokens of the whole."""
    size, at = size or AT_ONCE, 0
    while at < len(text):
        found = _BEGIN.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def _learn(self, pieces: set[str]) -> None:
        whole = [(p, self.ranks.get(p.encode())) for p in pieces]
        for p, rank in whole:
            if rank is not None:
                self.known[p] = rank.to_bytes(4, "little")
        rest = [p for p, rank in whole if rank is None]
        if rest:
            for p, ids in zip(rest, self.model.encode([p.encode().decode("latin-1").translate(self.shown) for p in rest], num_threads=1)):
                self.known[p] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self._encode(text) if len(text) <= AT_ONCE else b"".join(map(self._encode, stretches(text)))

    def _encode(self, text: str) -> bytes:
        pieces = self.cut(text)
        if new := set(pieces).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(pieces)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        index = np.frombuffer(ids, "<u4")
        if not len(index):
            return b""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.begins[index] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of long), the ids of each text. Any other columns stay, but for one of that name."""
    path = path or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("token_ids")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t), "<u4") for t in strings(batch.column(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "token_ids"])

    return docs.mapInArrow(part, docs.withColumn("token_ids", F.lit(None).cast("array<bigint>")).schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes of their ids; null ids count as none."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = rows.drop("decoded")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            found = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(part, rows.withColumn("decoded", F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each document: how many ids it has, and the digests of its ids and of what they decode to."""
    path = path or public_tokenizers.path(VOCABULARY)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            n, digests, decoded = [], [], []
            for t in strings(batch.column("text")):
                ids = coder.encode(t.as_py())
                n.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(part, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
