"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, one scan per text.

Texts and items are normalised alike: A-Z lower-cased, words of letters, digits and non-ASCII characters,
joined by single blanks. Every window of ``window`` consecutive item words (a shorter item is one window) is a
pattern with a blank on either side, so it only matches whole words. A match's end in the normalised text gives
its last word; the words' own offsets map it back to a character span of the original text.

The items are collected only in blocks whose windows have at most ``block_bytes`` characters, which bounds the
automaton, whatever the benchmark's size (a single larger item makes a block of its own). A task builds a block's
automaton once. With one block there is no shuffle at all; with more, each block scans the texts once more and the
table between two scans is written to the shared folder.

Defined results: null, empty and word-less texts have no words, no hits and no items (digest of the empty
string) and are not contaminated. Null or word-less items have no windows. An item whose id is repeated counts once.
Empty tables work. Clashing columns are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import common

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 12 << 20  # characters of windows: some 40 bytes of automaton each


def normalised(text: str | None) -> str:
    """Lower-cased A-Z; offsets stay those of the original."""
    return (text or "").encode().lower().decode()


def windows(words: list[str], size: int) -> list[str]:
    """The windows of an item as patterns."""
    if not words:
        return []
    return [f" {' '.join(words[i: i + size])} " for i in range(max(1, len(words) - size + 1))]


def automaton(items: tuple[tuple[int, str], ...], size: int):
    """The automaton of a block of items; a pattern's value is (number of words, places of its items); None if empty."""
    import ahocorasick
    owners: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in dict.fromkeys(windows(WORD.findall(normalised(text)), size)):
            owners.setdefault(w, []).append(k)
    if not owners:
        return None
    out = ahocorasick.Automaton()
    for w, ks in owners.items():
        out.add_word(w, (w.count(" ") - 1, ks))
    out.make_automaton()
    return out


def scan(text: str | None, items: tuple[tuple[int, str], ...], size: int) -> tuple[int, list[tuple[int, int]], list[int]]:
    """``found_in`` for one text and its items."""
    return found_in(text, automaton(items, size))


def found_in(text: str | None, machine) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Number of words, merged hit spans as [first word, last word + 1), places of the items that occur."""
    words = WORD.findall(normalised(text))
    if not words or machine is None:
        return len(words), [], []
    joined, found, hits, ends = f" {' '.join(words)} ", set(), [], None
    for end, (length, ks) in machine.iter(joined):
        if ends is None:  # where each word's closing blank stands
            ends, at = [], 0
            for w in words:
                at += len(w) + 1
                ends.append(at)
        last = bisect_right(ends, end)
        hits.append((last - length, last))
        found.update(ks)
    return len(words), _union(hits, []), sorted(found)


def item_blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark's items in blocks with windows of about ``block_bytes`` in all, each collected on its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, n = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = min(n, -(-(total or 0) * window // block_bytes))  # a word stands in as many windows as a window has words
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        yield tuple(sorted((r.item_id or "", r.text) for r in rows))


HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("chars", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
]


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (merged word spans that items cover), items (ids that occur, sorted, each once) and
    chars (the spans as code points of the original text)."""
    out, schema = common.extended(docs, HITS)
    first = True
    for block in item_blocks(benchmark, block_bytes, window) if benchmark is not None else ():
        if not first:
            out = materialize(out, "decontam")
        out, first = _scan_block(out, schema, block, window, first), False
    if first:  # no item at all
        out = _scan_block(out, schema, (), window, True)
    return out


def _scan_block(df: DataFrame, schema: T.StructType, block: tuple[tuple[int, str], ...], window: int, first: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(block)  # at most block_bytes, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, types, machine = shared.value, {f.name: f for f in HITS}, None
        for k, batch in enumerate(batches):
            machine = automaton(items, window) if k == 0 else machine
            counts, spans, ids = [], [], []
            for text in common.texts(batch):
                n, hit, found = found_in(text, machine)
                counts.append(n)
                spans.append(hit)
                ids.append(sorted({items[i][0] for i in found}))
            if not first:
                spans = [_union(a, [(s["first"], s["last"]) for s in b])
                         for a, b in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                ids = [sorted({*a, *b}) for a, b in zip(ids, batch.column("items").to_pylist(), strict=True)]
                batch = batch.drop_columns(list(types))
            texts = batch.column("text")
            chars = [char_spans(texts[i].as_py(), s) if s else [] for i, s in enumerate(spans)]
            pairs = [pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for a, b in (("first", "last"), ("begin", "end"))]
            yield common.appended(batch, {
                "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], pairs[0]),
                "items": pa.array(ids, pa.list_(pa.string())),
                "chars": pa.array([[{"begin": a, "end": b} for a, b in s] for s in chars], pairs[1])})

    return df.mapInArrow(run, schema)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as character spans of the original text."""
    at = [m.span() for m in WORD.finditer(normalised(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (hits on a twentieth of the words or more)."""
    names = ["n_hit", "n_items", "items_sha256", "contaminated"]
    found = find_items(common.without(docs, names), benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
            .drop("spans", "items", "chars"))


def digest(ids: list[str]) -> str:
    """The digest of a list of item ids, as ``judged`` reports it."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


# DuckDB twin: words by position, item windows of 13 words (or the whole of a shorter item), all window lengths
# that items have; a document window equal to an item window hits its words.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + 12], ' ') AS g
  FROM bw, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p(i) WHERE len(w) > 0),
doc_windows AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT k FROM item_windows) AS ks, unnest(generate_series(1, len(w) - k + 1)) AS p(i) WHERE len(w) >= k),
found AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.g = b.g),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(generate_series(i, i + k - 1)) AS p(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
