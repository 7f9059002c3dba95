import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from factweave.llm import lines, packing, quality
from tests.llm.test_search_and_tokens import check_packing
from tests.llm.test_texts import corpus, joined, without_repeats


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names and out.dtypes == docs.dtypes, name
        assert out.where("n_chars <> length(text)").count() == 0
        docs = out.cache()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] and sizes[3] <= sizes[2] and sizes[4] == sizes[3]
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_long_lines_go_alone(spark, sf):
    long = "word " * 50
    kept = cp.line_stage(spark, frame(spark, [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long)]), sf).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: f"a\n{long}\nb", 2: "c\nd", 3: ""}


def test_lines_go_as_brute_force_says(spark, sf):
    long = ["l" * 220, "m " * 150]
    rows = [(i, t if t is None or i % 3 else f"{long[i % 2]}\n{t}\n{long[1]}") for i, t in corpus(23, 60) if i is not None]
    rows = sorted(dict(rows).items())
    expected, windows, alone = {}, set(), set()
    for i, t in rows:
        every = [] if t is None else t.split("\n")
        at = [k for k, x in enumerate(every) if x.strip(" \t\r")]
        ink = [every[k].strip(" \t\r") for k in at]
        gone = set()
        for n, x in enumerate(ink):
            if len(x.encode()) >= lines.ALONE:
                gone |= {at[n]} if x in alone else set()
                alone.add(x)
            if n + 1 < len(ink):
                gone |= {at[n], at[n + 1]} if (x, ink[n + 1]) in windows else set()
                windows.add((x, ink[n + 1]))
        expected[i] = None if t is None else "\n".join(x for k, x in enumerate(every) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in cp.line_stage(spark, frame(spark, rows), sf).collect()} == expected
    assert sum(expected[i] != t for i, t in rows) > 10


def test_packing_stage_as_the_whole_tokenizer(spark, sf):
    texts = dict(dict((i, t) for i, t in corpus(24, 60) if i is not None))
    words = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    check_packing(cp.packing_stage(spark, frame(spark, texts.items()), sf).collect(), texts, words, packing.WINDOW)


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    rows = corpus(21)
    kept = cp.near_duplicate_stage(spark, frame(spark, rows), sf).collect()
    assert len({r["doc_id"] for r in kept} - {None}) == len({c for i, c, _ in joined(rows) if i is not None})
    assert {r["doc_id"] for r in kept} - {None} == {i for i, c, _ in joined(rows) if i is not None and i == c}
    assert sum(r["doc_id"] is None for r in kept) == sum(i is None for i, _ in rows)


def test_repeats_go_from_the_text(spark, sf):
    rows = [(i, t) for i, t in corpus(22, 40) if t is None or t.isascii()]
    kept = cp.repeat_stage(spark, frame(spark, rows), sf).collect()
    expected = sorted((str(i), k.decode()) for i, *_, k in without_repeats(rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == expected


def test_rejected_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    stays = {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in cp.quality_stage(spark, docs, sf).collect()} == stays
    clean = labels.where("quality = 1").join(docs, "doc_id")
    assert clean.join(cp.quality_stage(spark, docs, sf), "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_run(spark, sf):
    rows = cp.run(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    n = np.array([r["n"] for r in rows])
    assert ((n & (n - 1)) == 0).all() and (n == 4096).sum() >= len(n) - 12


def through(spark, docs, sf):
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    return docs


def test_empty_tables(spark, sf):
    assert through(spark, frame(spark, []), sf).count() == 0


def test_nulls_and_extra_columns(spark, sf):
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, "some words of text"), (3, "some words of text"), (4, "x" * 60 + " " + "y" * 60), (5, "x" * 60)]
    docs = frame(spark, rows).withColumns({"at": F.lit(1), "block": F.lit("b"), "score": F.lit(None), "component": F.lit(2), "key1": F.lit("k")})
    packed = through(spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} <= {None, 1, 2, 3, 4, 5} and all(r["length"] > 0 for r in packed)
