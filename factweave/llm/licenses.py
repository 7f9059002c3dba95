"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a line of a text, as its set of lower-cased words, or, for notices that are wrapped over lines, any run of as
many consecutive words as the template has, wherever lines end. It matches a template if it holds at least ``CONTAINED``
of the template's words. The words of all templates are ordered by how many texts of the corpus hold them, rarest
first. A block that reaches the threshold must hold one of the first words of a template in that order (the prefix
filter); the index of those words is of the templates' size, and is met by every block. Candidates must be long
enough (the length filter), and the place of the first common word must leave enough words after it (the positional
filter); those that remain are compared whole. Every block above the threshold is found.

Where two licenses are all but worded alike, a block must hold the word that tells them apart (``REQUIRED``).

Labels of phrases that stand as they are (the base) always stay; templates add theirs. ``score``: 1 where a base
phrase stands, else the largest containment of a template in a block, 0 where there is no candidate.

Null texts count as empty. Rows stand for themselves: repeated rows, ties and null ids are kept. Extra columns are
not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import table

CONTAINED = 0.9
#: Phrases as words, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as they are usually given, and their labels.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "spdx license identifier gpl 3 0 or later"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "spdx license identifier apache 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: What tells a license from one that is all but worded alike: no block without this word gets the label.
REQUIRED = {"agpl": "affero", "lgpl": "lesser", "cc-by-nc": "nc", "cc-by-sa": "sa"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters, named themselves: Java's matcher takes several times as long where a class of three ranges is negated.
JAVA_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_WORD), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _templates(templates: list[tuple[str, str]]) -> list[tuple[str, frozenset[str]]]:
    return [(label, frozenset(text.split())) for label, text in templates]


def _needed(n: int, contained: float) -> int:
    return max(1, math.ceil(contained * n - 1e-9))


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted(frozenset().union(*(words for _, words in _templates(templates))))


def held_by(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """How many texts of the corpus hold each word of the templates. At most a row for each such word is collected."""
    held = docs.select(F.explode(F.array_intersect(word_list(F.lower("text")), strings(_vocabulary(templates)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _starts(words: Column, phrase: list[str]) -> Column:
    """Where a phrase's words stand consecutively."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all([F.coalesce(F.get(words, i + k), F.lit("")) == w for k, w in enumerate(phrase)]))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans``.

    ``spans``: each matching line's number (from 0), the label and the containment; of a run of words that holds more of a
    template than any line, the number is null. The index of the templates is a literal of the plan, so all blocks are
    met where they lie and no row is shuffled but counts of words. Each text is first met whole, as one block: only texts
    that hold enough of a template, or a first word of a base phrase, are cut into lines and runs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequency = held_by(docs, templates)
    by_rank = sorted(_vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(by_rank)}
    sets = [sorted(words, key=rank.get) for _, words in _templates(templates)]
    needed = [_needed(len(words), contained) for words in sets]
    index: dict[str, list[int]] = {}
    for t, words in enumerate(sets):
        for w in words[: len(words) - needed[t] + 1]:
            index.setdefault(w, []).append(t)
    prefix, vocabulary = sorted(index, key=rank.get), strings(by_rank)
    ints = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<int>")
    index_of = F.create_map(*(x for w in prefix for x in (F.lit(w), ints(index[w]))))
    lengths = [len(text.split()) for _, text in templates]
    length_of, needed_of, labels_of = ints(lengths), ints(needed), strings([label for label, _ in templates])
    held_of = F.array(*(strings(words) for words in sets))
    required_of = strings([REQUIRED.get(label, "") for label, _ in templates])
    enough = lambda words, t: (F.get(required_of, t) == "") | F.array_contains(words, F.get(required_of, t))
    held = lambda words, t: F.when(enough(words, t), F.size(F.array_intersect(words, F.get(held_of, t)))).otherwise(0)
    share = lambda words, t: held(words, t) / F.size(F.get(held_of, t))

    def ordered(words: Column) -> Column:
        """A block's template words, rarest first."""
        return F.array_intersect(vocabulary, F.array_intersect(words, vocabulary))

    def candidates(block: Column) -> Column:
        """Templates of which the block holds a word of the prefix, with enough words from there on."""

        def met(w: Column, place: Column) -> Column:
            return F.filter(F.when(w.isin(prefix), F.element_at(index_of, w)).otherwise(ints([])), lambda t: F.size(block) - place >= F.get(needed_of, t))

        return F.array_distinct(F.flatten(F.transform(block, met)))

    def matches(block: Column, line: Column) -> Column:
        found = F.transform(candidates(block), lambda t: F.struct(line.cast("long").alias("line"), F.get(labels_of, t).alias("label"), share(block, t).alias("contained")))
        return F.filter(found, lambda m: m["contained"] >= contained - 1e-9)

    def wrapped(words: Column, near_ones: Column) -> Column:
        """Matches of runs of as many words as the template has, one for each place of a word of its prefix."""

        def near(i: Column, t: Column) -> Column:
            """Words that a run with the place in it can have."""
            begin = F.greatest(i - F.get(length_of, t) + 1, F.lit(0))
            return F.slice(words, begin + 1, i - begin + F.get(length_of, t))

        def most(i: Column, t: Column) -> Column:
            run = lambda begin: F.slice(words, begin + 1, F.get(length_of, t))
            every = F.transform(F.sequence(F.greatest(i - F.get(length_of, t) + 1, F.lit(0)), i), lambda begin: held(run(begin), t))
            return F.array_max(every) / F.size(F.get(held_of, t))

        def met(i: Column) -> Column:
            ts = F.filter(F.array_intersect(F.element_at(index_of, F.get(words, i)), near_ones), lambda t: held(near(i, t), t) >= F.get(needed_of, t))
            return F.transform(ts, lambda t: F.struct(F.lit(None).cast("long").alias("line"), F.get(labels_of, t).alias("label"), most(i, t).alias("contained")))

        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(prefix))
        return F.filter(F.array_distinct(F.flatten(F.transform(places, met))), lambda m: m["contained"] >= contained - 1e-9)

    def both(by_line: Column, by_run: Column) -> Column:
        """Those of lines, and those of runs that tell more."""
        more = lambda m: ~F.exists(by_line, lambda b: (b["label"] == m["label"]) & (b["contained"] >= m["contained"]))
        return F.concat(by_line, F.filter(by_run, more))

    # A-Z alone are lowered, but first all letters: that is quicker, joins and parts no words, and every word of ASCII stays met
    quick = docs.withColumn("quick", word_list(F.lower("text")))
    quick = quick.withColumn("held", ordered(F.col("quick")))
    quick = quick.select(
        "doc_id",
        "text",
        F.size("quick").cast("long").alias("n_words"),
        F.arrays_overlap("quick", strings(sorted({p.split()[0] for p in PHRASES}))).alias("any_base"),
        F.filter(candidates(F.col("held")), lambda t: share(F.col("held"), t) >= contained - 1e-9).alias("near"),
    )
    words = quick.withColumn("low", F.when(F.col("any_base") | (F.size("near") > 0), lowered(F.col("text")))).drop("text").withColumn("words", word_list(F.col("low")))
    places = F.array(*(F.struct(F.lit(label).alias("label"), F.when(F.array_contains("words", p.split()[0]), _starts(F.col("words"), p.split())).otherwise(ints([])).alias("at")) for p, label in PHRASES.items()))
    none = "array<struct<label:string,at:array<int>>>"
    spans = "array<struct<line:bigint,label:string,contained:double>>"
    blocks = F.transform(F.split("low", "\n"), lambda line, i: F.struct(i.alias("line"), ordered(word_list(line)).alias("words")))
    blocks = F.filter(blocks, lambda b: F.size(b["words"]) >= min(needed))  # the length filter
    found = words.select(
        "doc_id",
        "n_words",
        F.when(F.col("any_base"), F.filter(places, lambda p: F.size(p["at"]) > 0)).otherwise(F.array().cast(none)).alias("base"),
        F.when(F.size("near") > 0, both(F.flatten(F.transform(blocks, lambda b: matches(b["words"], b["line"]))), wrapped(F.col("words"), F.col("near")))).otherwise(F.array().cast(spans)).alias("spans"),
    )
    starts = F.flatten(F.transform("base", lambda b: b["at"]))
    base_labels = F.transform("base", lambda b: b["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        _joined(base_labels).alias("base_labels"),
        _joined(F.concat(base_labels, F.transform("spans", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda m: m["contained"])), F.lit(0.0))).alias("score"),
        "spans",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    def listed(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    places = ",\n    ".join(
        f"list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k + 1}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(p.split()))}) AS p{n}" for n, p in enumerate(PHRASES)
    )
    base = " || ".join(f"CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END" for n, label in enumerate(PHRASES.values()))
    held = ",\n    ".join(f"{{'label': '{label}', 'words': {listed(sorted(set(text.split())))}, 'n': {len(text.split())}, 'required': '{REQUIRED.get(label, '')}'}}" for label, text in TEMPLATES)
    return f"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
), words AS (
  SELECT doc_id, low, regexp_extract_all(low, '{WORD}') AS words FROM low
), blocks AS (
  SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM low
), templates AS (
  SELECT unnest([{held}], recursive := true)
), near AS (
  SELECT doc_id, w.words AS own, t.label, t.words, t.n, t.required FROM words AS w, templates AS t WHERE len(list_intersect(list_distinct(w.words), t.words)) >= {CONTAINED} * len(t.words) - 1e-9
), runs AS (
  SELECT doc_id, label, list_max(list_transform(range(len(own)), lambda i: CASE WHEN required = '' OR list_contains(own[i + 1:i + n], required) THEN len(list_intersect(list_distinct(own[i + 1:i + n]), words)) ELSE 0 END)) / len(words) AS contained FROM near
), matches AS (
  SELECT b.doc_id, t.label, len(list_intersect(b.held, t.words)) / len(t.words) AS contained
  FROM (SELECT doc_id, list_distinct(regexp_extract_all(line, '{WORD}')) AS held FROM blocks) AS b, templates AS t WHERE t.required = '' OR list_contains(b.held, t.required)
  UNION ALL SELECT doc_id, label, contained FROM runs
), best AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(contained) AS contained FROM matches WHERE contained >= {CONTAINED} - 1e-9 GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words) AS n_words,
    {places}
  FROM words
), joined AS (
  SELECT b.doc_id, n_words, {" || ".join(f"p{n}" for n in range(len(PHRASES)))} AS starts, {base} AS base_labels, coalesce(found, []) AS found, coalesce(contained, 0) AS contained
  FROM base AS b LEFT JOIN best USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
  CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base_labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base_labels || found)), ','), '') AS labels,
  CAST(CASE WHEN len(starts) > 0 THEN 1.0 ELSE contained END AS DOUBLE) AS score
FROM joined
"""


ORACLE_SQL = _sql()
