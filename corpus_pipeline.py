"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept. All but the last return the columns of ``documents``, with ``n_chars``
that of the text as it then is:

1. ``quality``: documents that the classifier rejects go.
2. ``line_dedup``: lines of runs that occurred before go, and long lines (``lines.ALONE``) that did.
3. ``near_duplicates``: of each group that links of similarity 0.8 or more join, the document with the least id stays.
   Rows without an id stay.
4. ``repeats``: bytes of 50-byte strings that a document with a smaller id has go.
5. ``packing``: what is left becomes sequences of 4096 ids.

A document of which a stage leaves nothing stays as a row with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import jaccard, lines, packing, quality, suffixes
from factweave.llm.common import drop_scratch, scratch_tables, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(lines.dedup(docs.select(*COLUMNS), alone=lines.ALONE))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    stays = jaccard.join(docs).where("doc_id = class_id").select("doc_id").distinct()
    # repeated rows are copies too
    once = docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(suffixes.dedup(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]
#: Scores, sketches and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table. Scratch tables of a stage go when the next one's input is written."""
    others = scratch_tables()
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), few=False)
        drop_scratch(spark, [*others, scratch_tables()[-1]])
    packed = STAGES[-1][1](spark, docs, sf_dir)  # of checkpoints
    drop_scratch(spark, others)
    return packed
