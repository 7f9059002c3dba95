import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factweave.llm import bpe, packing, topk

ODD = [None, "", " ", "a  b\n\n c", "İstanbul ΣΑΣ Σ", "éa ́x", "x y z​q", "it's DON'T 'S ab\x1ccd", "½ ² 12ab3", "<|endoftext|> a<|endoftext|>b", "naïve ÀÉ ŐŰ ǅ ß", "漢字 кириллица", "a\tb\r\nc\x0bd\x85e", "🙂a👩‍👩‍👧", "\x00\x01", "x" * 5000, " " * 3000, "word " * 20000]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, token_ids string, sequence_id int")


# byte-level BPE
@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path(bpe.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_codec_like_tiktoken(reference, codec, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '1.\n\t é", max_size=60), st.integers(1, 7))
def test_long_texts_in_parts(reference, codec, text, size):
    parts = list(bpe.stretches(text, size))
    assert "".join(parts) == text
    assert sum((reference.encode_ordinary(p) for p in parts), []) == reference.encode_ordinary(text)


def test_very_long_texts(words, codec, reference):
    text = "many words, 'tis said;  \n" * 100_000
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY)).encode(text)
    assert np.frombuffer(own, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, reference):
    rows = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, [*ODD, "same", "same"])).collect()}
    for i, t in enumerate([*ODD, "same", "same"]):
        ids = reference.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_and_decode_columns(spark, reference):
    back = bpe.decode(bpe.encode(documents(spark, ODD))).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [t or "" for t in ODD]
    assert back[3]["token_ids"] == reference.encode_ordinary(ODD[3]) and back[3]["sequence_id"] == 1
    assert bpe.round_trip(documents(spark, [])).count() == 0


def test_model_needs_whole_ranks():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


# packing
@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_word_tokenizer_like_the_whole_one(words, text):
    own = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY)).encode(text)
    assert np.frombuffer(own, "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "A <|startoftext|><|endoftext|> é<|endoftext", "<|ENDOFTEXT|>", "x<|endoftext|>\u0301y", "ΣΑ<|endoftext|>Σ", "<|startoftext|>\n" * 3, "<|start<|endoftext|>oftext|>"])
def test_added_tokens(words, text):
    own = np.frombuffer(packing.tokenizer(public_tokenizers.path(packing.VOCABULARY)).encode(text), "<u4").tolist()
    assert own == words.encode(text, add_special_tokens=False).ids
    assert ("<|endoftext|>" in text) == (49407 in own) and ("<|startoftext|>" in text) == (49406 in own)


def check_packing(rows, texts, words, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*words.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    short = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: no padding
        short += [at] * (at < size)
    assert len(short) == len(set(short))


def test_packing(spark, words):
    texts = dict(enumerate([*ODD, *(f"some text number {i} " * (i % 60) for i in range(300))]))
    check_packing(packing.pack(documents(spark, texts.values()).repartition(7)).collect(), texts, words, packing.WINDOW)
    check_packing(packing.pack(documents(spark, texts.values()).repartition(70), size=64, n_open=3).collect(), texts, words, 64)


def test_packing_rounds_over_many_partitions(spark, words):
    texts = {i: f"a few words {i}" for i in range(200)}
    check_packing(packing.pack(documents(spark, texts.values()).repartition(70), size=256).collect(), texts, words, 256)


def test_packing_edges(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (None, None), (1, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert len(rows) == 4 and sum(r["length"] for r in rows) == 7
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), size=100)


# top-k
def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        found = sorted(((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)))
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 6), st.integers(0, 1 << 30))
def test_bit_slices(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-6, 6, (n, dims))
    ids = rng.permutation(n)
    index = topk.BitSlices(ids, values)
    for i in range(min(n, 5)):
        query = rng.integers(-9, 9, dims)
        expected = brute(list(zip(ids.tolist(), values)), [(int(ids[i]), query)], k)[int(ids[i])]
        assert index.top(int(ids[i]), query, k) == [(i, s) for _, i, s in expected]


def test_search(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 8)).round(1).astype(float)
    base[50:120] = base[3]  # ties
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(base)]
    rows += [(1000, None, "x", 1), (1001, [1.0, None] * 4, "x", 1), (1002, [float("nan")] * 8, "x", 1), (1050, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1), (1100, [0.5], "x", 1), (1150, [], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    fine = topk.quantised(df)
    found = defaultdict(list)
    for r in topk.search(fine, fine.where("vec_id % 50 = 0"), block_rows=64, chunk=3).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = [(i, np.floor(256 * v).astype(int)) for i, v in enumerate(base)]
    expected = brute(vectors, [(i, v) for i, v in vectors if i % 50 == 0], 5)
    assert {q: sorted(x) for q, x in found.items()} == expected


def test_blocks_meet_chunks_in_many_tasks(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-3, 4, (500, 4)).astype(float)
    fine = topk.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>"))
    found = topk.search(fine, fine.where("vec_id % 5 = 0"), block_rows=50, chunk=10)
    rows = found.collect()
    expected = brute([(i, np.floor(256 * v).astype(int)) for i, v in enumerate(base)], [(i, np.floor(256 * base[i]).astype(int)) for i in range(0, 500, 5)], 5)
    own = defaultdict(list)
    for r in rows:
        own[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in own.items()} == expected
    tasks = topk.tasks_of(fine, fine.where("vec_id % 5 = 0"), 50, 10)
    dealt = tasks.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) >= 100 and len(dealt) > 40 and max(r["count"] for r in dealt) < 12


def test_search_edges(spark):
    empty = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(empty, empty).count() == 0
    one = topk.quantised(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (7, [-0.001]), (7, [-0.001])], "vec_id long, embedding array<double>"))
    rows = topk.search(one, one.where("vec_id % 50 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(50, 1, 7, -256), (50, 2, 7, -256)]
