"""License scans: an exact set-similarity join of text blocks with license notices. DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Two things are looked for:

* **Phrases** (the base): every place where a phrase's words stand consecutively.
* **Notices** (the join): a text's blocks are its windows of ``BLOCK`` words, one every ``STRIDE``. A block meets a
  notice if it holds at least ``threshold`` of the notice's distinct words. All such pairs are found, by a join on
  words in one global order, rarest in the corpus first (documents that hold the word, over all documents):
  the least overlap of a notice of n words is a = ceil(threshold * n);
  *prefix filter*: the two share one of the notice's first n - a + 1 words and one of the block's first b - a + 1;
  *length filter*: the block has at least a words that occur in any notice;
  *positional filter*: no more can be shared than stands before and behind a shared word;
  what is left is verified by the whole overlap.

Words that occur in no notice cannot be shared and are left out of the blocks. Blocks without a word of any notice's
prefix are never formed, so little of a text is touched, and nothing but the matches of single documents is shuffled.
The scan's rows are numbered and written to the shared folder, so a row's number is fixed and repeated rows or
frequent texts make no hot key. Phrases and notices are parameters; they are literals of the plan, at most ``NOTICES``.

Defined results: a null text is the empty text. Texts without words have no places, empty label strings and score 0.
The score is 1 where a phrase occurs, else the greatest share of a notice found in a block, 0 if none is found.
Repeated rows and null ids each give a row. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 64, 32
NOTICES = 1000

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening sentences and short notices of public licenses (at most STRIDE words each), with their labels.
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def notice_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def notice_sets(notices: list[tuple[str, str]], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, least overlap) of every notice that has words."""
    sets = [(label, list(dict.fromkeys(notice_words(text)))) for label, text in notices]
    if len(sets) > NOTICES:
        raise ValueError(f"at most {NOTICES} notices are joined at once")
    return [(label, words, math.ceil(round(threshold * len(words), 9))) for label, words in sets if words]


def lowered(text: Column) -> Column:
    """A-Z lower-cased. The two other letters that lower to ASCII ones are first replaced by letters that do not."""
    kept = F.coalesce(text, F.lit(""))
    for letter, other in (("\u212a", "\ue000"), ("\u0130", "\ue001")):
        kept = F.replace(kept, F.lit(letter), F.lit(other))
    return F.lower(kept)


def words_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.regexp_extract_all(lowered(F.col("text").cast("string")), F.lit(WORD), F.lit(0)).alias("w"))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def corpus_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The notices' words, those in fewest documents first; one row per word of the notices comes to the driver."""
    found = words_of(docs).select(F.explode(F.array_intersect(strings(vocabulary), F.col("w"))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scanned(docs: DataFrame, phrases: dict[str, str], order: list[str], prefix_words: list[str]) -> DataFrame:
    """One numbered row per document: n_words, places of the phrases, and the blocks that hold a word of some prefix."""
    spoken = [(notice_words(p), label) for p, label in phrases.items()]
    marks = sorted({words[0] for words, _ in spoken} | set(prefix_words))
    rows = words_of(docs).withColumn("marks", F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                                                       lambda m: m["w"].isin(marks)))

    def places(words: list[str]) -> Column:
        here = F.filter("marks", lambda m: (m["w"] == words[0]) & (F.slice(F.col("w"), m["i"] + 1, F.lit(len(words))) == strings(words)))
        return F.transform(here, lambda m: m["i"])

    rows = rows.withColumns({f"places{k}": places(words) for k, (words, _) in enumerate(spoken)})
    each = [F.col(f"places{k}") for k in range(len(spoken))]
    prefix = F.filter("marks", lambda m: m["w"].isin(prefix_words))
    # word i lies in the blocks i // STRIDE and, as BLOCK is twice STRIDE, the one before
    touched = F.array_distinct(F.flatten(F.transform(prefix, lambda m: F.sequence(
        F.greatest(F.floor(m["i"] / STRIDE).cast("int") - 1, F.lit(0)), F.floor(m["i"] / STRIDE).cast("int")))))
    blocks = F.transform(touched, lambda b: F.struct(b.alias("block"), F.array_intersect(
        strings(order), F.slice(F.col("w"), b * STRIDE + 1, F.lit(BLOCK))).alias("words")))
    every = F.concat(*each)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(e) > 0, F.lit(label)) for e, (_, label) in zip(each, spoken, strict=True)])).alias("base"),
        blocks.alias("blocks"))


def similar_blocks(rows: DataFrame, sets: list[tuple[str, list[str], int]], order: list[str]) -> DataFrame:
    """(row, block, notice, label, share): every block that meets a notice, each pair once."""
    rank = {w: k for k, w in enumerate(order)}
    entries = []
    for k, (label, words, least) in enumerate(sets):
        ranked = sorted(words, key=rank.get)
        entries += [F.struct(F.lit(w).alias("word"), F.lit(i).alias("at"), F.lit(k).alias("notice"), F.lit(label).alias("label"),
                             strings(ranked).alias("notice_words"), F.lit(least).alias("least"))
                    for i, w in enumerate(ranked[: len(ranked) - least + 1])]
    spark = rows.sparkSession
    index = spark.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")  # bounded: at most NOTICES notices
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", F.col("b.words").alias("words"))
    blocks = blocks.where(F.size("words") >= min(least for _, _, least in sets))
    probes = blocks.select("row", "block", "words", F.posexplode("words").alias("j", "word"))
    near = probes.join(F.broadcast(index), "word")
    n, b, a = F.size("notice_words"), F.size("words"), F.col("least")
    near = near.where(b >= a)  # length
    near = near.where(F.col("j") <= b - a)  # the block's prefix
    near = near.where(F.least("at", "j") + F.least(n - F.col("at"), b - F.col("j")) >= a)  # position
    earlier = F.array_intersect(F.slice(F.col("words"), F.lit(1), F.col("j")), F.slice(F.col("notice_words"), F.lit(1), n - a + 1))
    near = near.where(F.size(earlier) == 0)  # a pair is met at its first shared word only
    shared = F.size(F.array_intersect("notice_words", "words"))
    return near.withColumn("shared", shared).where(F.col("shared") >= a).select(
        "row", "block", "notice", "label", (F.col("shared") / n).alias("share"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = TEMPLATES,
         threshold: float = 0.9) -> DataFrame:
    """Phrase places and license labels of every document."""
    sets = notice_sets(notices, threshold)
    order = corpus_order(docs, sorted({w for _, words, _ in sets for w in words}))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = sorted({w for _, words, least in sets for w in sorted(words, key=rank.get)[: len(words) - least + 1]})
    rows = materialize(scanned(docs, phrases, order, prefixes), "license-scan")
    met = similar_blocks(rows, sets, order).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return rows.drop("blocks").join(met, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("base"))).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def oracle(phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> str:
    """DuckDB twin: words by position; phrases by self-joined positions; blocks against notices by plain overlap counts."""
    spoken = ", ".join(f"('{label}', {notice_words(p)!r})" for p, label in phrases.items())
    sets = notice_sets(notices, threshold)
    held = ", ".join(f"({k}, '{label}', {len(words)}, {least}, {words!r})" for k, (label, words, least) in enumerate(sets))
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, i, w[i + 1] AS word FROM w, unnest(generate_series(0, len(w) - 1)) AS p(i)),
phrases(label, words) AS (VALUES {spoken}),
base AS (
  SELECT w.r, pos.i, p.label FROM pos JOIN phrases p ON pos.word = p.words[1] JOIN w USING (r)
  WHERE w.w[pos.i + 1 : pos.i + len(p.words)] = p.words),
bases AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last FROM base GROUP BY r),
notices(k, label, n, least, words) AS (VALUES {held}),
terms AS (SELECT k, label, n, least, unnest(words) AS word FROM notices),
met AS (
  SELECT r, b, k, any_value(label) AS label, count(DISTINCT pos.word) / any_value(n)::DOUBLE AS share
  FROM pos JOIN terms USING (word), unnest([i // {STRIDE} - 1, i // {STRIDE}]) AS s(b)
  WHERE b >= 0 GROUP BY r, b, k HAVING count(DISTINCT pos.word) >= any_value(least)),
best AS (SELECT r, max(share) AS share FROM met GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT r, label FROM base) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s
  FROM (SELECT r, label FROM base UNION SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(bases.n, 0) AS BIGINT) AS n_base, bases.first AS first_word,
  bases.last AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
  CASE WHEN bases.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN bases USING (r) LEFT JOIN best USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r)
"""
