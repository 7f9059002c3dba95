"""Line deduplication by winnowing over line hashes.

Lines are hashed without white space at their ends; blank lines are passed over. Of each ``RUN`` consecutive lines the
one with the least hash (of equals the last) is a fingerprint, so any run of that many lines that two places share
holds a common fingerprint. These positions alone leave the texts, with a hash of the lines on either side as far as the
windows that chose them reach. Fingerprints that occur once are dropped; the positions of the others are joined, and each match is
extended both ways over those lines: it holds as far as they are the same at an earlier place (in a smaller id, or earlier
in the same document). Extended matches that overlap join to maximal runs, and all lines of later runs go; the first
occurrence stays. A line end goes with its line. Lines are compared by 64 bits each, so a run of two by 128.

Lines that repeat alone, between neighbours that differ, are no repeats of windows and stay, however long, unless
``alone`` is given: then later occurrences of every line of that many bytes or more go as well, those of texts of one
line too. The pipeline gives ``ALONE``; ``op6_line_dedup`` has the windows alone, as its SQL does.

Null texts have no lines and stay null; texts with fewer than ``RUN`` lines lose nothing to windows. Rows are told apart by id
and text; equal rows count as one document and are changed alike; null ids come after all others. All columns
are kept, whatever their names, but for ``n_lines_removed``, which is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import RollingHash, mix, raw, runs, strings, table, written

RUN = 2
#: Bytes, without white space at the ends, from which on a line that repeats alone goes in the pipeline.
ALONE = 200
LINE_HASH = RollingHash(23)
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\r"]] = True


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, number within its row and length of each line that isn't blank."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < n]
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(offsets[row + 1], np.append(breaks, n)[np.searchsorted(breaks, starts)])
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    number = np.arange(len(row)) - np.repeat(begins, np.diff([*begins, len(row)]))
    # the first and last byte of each line that isn't white space
    ink = np.flatnonzero(~_BLANK[data] & (data != 10))
    first, after = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    full = first < after
    first, after, row, number = first[full], after[full], row[full], number[full]
    if not len(first):
        return np.zeros(0, np.uint64), row, number, first
    begin, end = ink[first], ink[after - 1] + 1
    return mix(LINE_HASH.between(LINE_HASH.prefix(data), begin, end)), row, number, end - begin


def _chosen(hashes: np.ndarray, row: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First line of each window within a row, and the line that it chooses (the last of the least)."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(row[:n] == row[run - 1 :])
    best = start.copy()
    for k in range(1, run):
        best = np.where(hashes[start + k] <= hashes[best], start + k, best)
    return start, best


def _others(hashes: np.ndarray, start: np.ndarray, best: np.ndarray, run: int) -> np.ndarray:
    """A hash of the lines of each window but for the chosen one, in their order."""
    out = np.zeros(len(start), np.uint64)
    for k in range(run):
        out = np.where(start + k == best, out, mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k]) if len(start) else out)
    return out


def positions(docs: DataFrame, run: int = RUN, alone: int | None = None) -> DataFrame:
    """``at, text_hash, fingerprint, place`` of each chosen line, and ``windows``: of each that chose it how far before it begins and a hash of
    its other lines. Lines of ``alone`` bytes are positions too, with a window of themselves (``back`` -1)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(strings(batch.column("text")))
            for lo, hi in runs(offsets):
                h, row, _, length = line_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                start, best = _chosen(h, row, run)
                back, rest = best - start, _others(h, start, best, run)
                long = np.zeros(0, np.int64) if alone is None else np.flatnonzero(length >= alone)
                line, back, rest = np.append(best, long), np.append(back, np.full(len(long), -1)), np.append(rest, np.zeros(len(long), np.uint64))
                order = np.argsort(line, kind="stable")
                line, back, rest = line[order], back[order], rest[order]
                head = np.flatnonzero(np.diff(line, prepend=-1))
                windows = pa.ListArray.from_arrays(pa.array(np.append(head, len(line)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(back.astype(np.int32)), pa.array(rest.view(np.int64))], ["back", "rest"]))
                line = line[head]
                index = pa.array(row[line] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at").take(index), batch.column("text_hash").take(index), pa.array(h[line].view(np.int64)), pa.array((line - np.searchsorted(row, row[line])).astype(np.int32)), windows],
                    ["at", "text_hash", "fingerprint", "place", "windows"],
                )

    return docs.select("at", "text_hash", "text").mapInArrow(part, "at long, text_hash long, fingerprint long, place int, windows array<struct<back: int, rest: bigint>>")


def extended(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``at, text_hash, place, back`` of the windows around joined positions that also stand at an earlier place.

    Positions are joined by their fingerprint and extended by the window's other lines; the earliest place stands for all
    before, so a fingerprint of any number of places costs each of them one row a window.
    """
    met = found.join(shared, "fingerprint", "left_semi").select("fingerprint", "at", "text_hash", "place", F.explode("windows").alias("w")).select("fingerprint", "at", "text_hash", "place", "w.back", "w.rest")
    met = written(met, few=False)
    here = F.struct("at", "text_hash", "place")
    first = met.groupBy("fingerprint", "back", "rest").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").select("fingerprint", "back", "rest", "first")
    return met.join(first, ["fingerprint", "back", "rest"]).where(F.struct("at", "text_hash", "place") > F.col("first")).select("at", "text_hash", "place", "back")


def _without(text: str | None, gone: list[dict] | None, run: int) -> tuple[str | None, int]:
    """The text without the runs that windows join to, and without lines alone (blank lines are not counted)."""
    if text is None or not gone:
        return text, 0
    drop = {g["place"] - max(g["back"], 0) + k for g in gone for k in range(1 if g["back"] < 0 else run)}
    kept, n, removed = [], 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            if n in drop:
                removed += 1
            else:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), removed


def dedup(docs: DataFrame, run: int = RUN, alone: int | None = None) -> DataFrame:
    """``docs`` with the lines of repeated runs, and repeated lines of ``alone`` bytes, taken out of ``text``, and ``n_lines_removed``."""
    names = [c for c in docs.columns if c != "n_lines_removed"]
    docs = docs.select(*names)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("at"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(positions(keyed, run, alone), few=False)
    shared = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    gone = extended(found, shared).groupBy("at", "text_hash").agg(F.collect_set(F.struct("place", "back")).alias("gone")).withColumnsRenamed({"at": "gone_at", "text_hash": "gone_hash"})
    whole = docs.select(F.struct(*names).alias("doc")).withColumns({"at": F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1)), "text_hash": F.xxhash64("doc.text")})
    whole = whole.join(gone, (F.col("at") == F.col("gone_at")) & (F.col("text_hash") == F.col("gone_hash")), "left")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            columns = dict(zip(names, doc.flatten()))
            done = [_without(t, g, run) for t, g in zip(columns["text"].to_pylist(), batch.column("gone").to_pylist())]
            columns["text"] = pa.array([t for t, _ in done], columns["text"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([n for _, n in done], pa.int64())], [*names, "n_lines_removed"])

    return whole.select("doc", "gone").mapInArrow(part, docs.withColumn("n_lines_removed", F.lit(0).cast("long")).schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines_removed", F.octet_length("text").cast("long").alias("n_bytes_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")


ORACLE_SQL = """
WITH every AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), inked AS (
  SELECT doc_id, place, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM every WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), pairs AS (
  SELECT doc_id, place, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM inked
), first AS (
  SELECT line, after, min({'doc_id': doc_id, 'n': n}) AS at FROM pairs WHERE after IS NOT NULL GROUP BY line, after
), repeats AS (
  SELECT p.doc_id, p.n FROM pairs AS p JOIN first AS f ON p.line = f.line AND p.after = f.after WHERE {'doc_id': p.doc_id, 'n': p.n} > f.at
), gone AS (
  SELECT DISTINCT doc_id, n FROM (SELECT doc_id, n FROM repeats UNION ALL SELECT doc_id, n + 1 FROM repeats)
), kept AS (
  SELECT e.doc_id, e.place, e.line, g.n IS NOT NULL AS gone FROM every AS e LEFT JOIN inked AS i ON e.doc_id = i.doc_id AND e.place = i.place LEFT JOIN gone AS g ON i.doc_id = g.doc_id AND i.n = g.n
), texts AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_lines_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines_removed, 0) AS n_lines_removed, CAST(strlen(t.text) AS BIGINT) AS n_bytes_kept, sha256(t.text) AS kept_sha256, t.text AS text
FROM documents AS d LEFT JOIN texts AS t ON d.doc_id = t.doc_id
"""
