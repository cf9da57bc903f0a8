"""Filter interaction audit: what each of five filters removes, in every order of them.

Conditions of a text (words: maximal ``[^\\x20\\x09-\\x0D]+``): A under 200 words; B fewer than half its words distinct;
C over 2 % capitals A-Z; D holds one of ``#$%&*|``; E identical to the text of a smaller doc_id, whatever else
holds. A row's failures are a mask of five bits, and masks are all that the audit needs.

E by radix tries. Every task of the scan inserts its texts into a compressed trie whose terminals hold the minimum
id seen; all rows above it are settled at once, so a text leaves one row a trie, however often it occurs, and a trie
is emptied only when it holds ``HELD`` bytes of different texts or its task ends. What is left goes to ranges of
texts: bounds are the shortest prefixes that cut the texts' bytes into even parts, as many as there are shuffle
partitions, found from keys that every trie gives (merged in ``MERGERS`` tasks; the driver gets at most
``MERGERS * MERGED`` keys a partition). A prefix grows until it tells the texts apart, so many texts with one beginning
are still dealt out. Range tasks read their texts in order, so a trie over ``HELD`` bytes is emptied between two
texts, and memory stays bounded for a range of any size.

Defined results: a null text is the empty text; a null source is the empty string. A null doc_id is neither smaller
nor greater: such a row never fails E and makes no other fail. Repeated rows of a text's least id pass E. A doc_id
with several label rows is good (toxic) if any of them says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common, radix

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
LEAST_WORDS = 200
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"

HELD = 32 << 20
KEYS, MERGERS, MERGED = 64, 16, 4
SETTLED, OPEN, KEY = 0, 1, 2
ROWS = "kind int, doc_id long, part string, mask int, text binary, parts array<string>, trie string, weight long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.int64()]


def text_mask(text: bytes, points: int) -> int:
    """Failures A to D of a text given as UTF-8 and by its number of code points."""
    words = text.split()  # bytes split at exactly the six ASCII blanks
    capitals = len(text) - len(text.translate(None, CAPITALS))
    failures = (len(words) < LEAST_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * points,
                len(text.translate(None, MARKS)) < len(text))
    return sum(1 << k for k, fails in enumerate(failures) if fails)


class Record:
    """What a terminal holds: the text's mask, its minimum id, and the parts of the rows with that id."""

    __slots__ = ("mask", "doc", "parts")

    def __init__(self, mask: int, doc: int, parts: list[str]):
        self.mask, self.doc, self.parts = mask, doc, parts

    def meet(self, doc: int, parts: list[str]) -> list[tuple[int, str]]:
        """Take in rows of one id; returns the rows that are now known to have a smaller one."""
        if doc == self.doc:
            self.parts.extend(parts)
            return []
        if doc > self.doc:
            return [(doc, p) for p in parts]
        beaten, self.doc, self.parts = [(self.doc, p) for p in self.parts], doc, list(parts)
        return beaten


def batches_of(rows: list[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        columns = zip(*rows[at: at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def settled(doc: int | None, part: str, mask: int) -> tuple:
    return SETTLED, doc, part, mask, None, None, None, None


def left_open(trie: radix.Trie, with_keys: bool) -> Iterator[pa.RecordBatch]:
    """The trie's texts, each with its minimum id, and about ``KEYS`` keys that cut their bytes evenly."""
    name, rows, keys, size = uuid.uuid4().hex, [], [], 0
    for text, record, key in trie.walk():
        rows.append((OPEN, record.doc, None, record.mask, text, record.parts, name, None))
        keys.append((key, len(text) + 1))
        size += len(text)
        if size > 1 << 20:
            yield from batches_of(rows)
            rows, size = [], 0
    yield from batches_of(rows)
    if with_keys:
        cuts = radix.weighted_cuts(keys, KEYS, radix.phase_of(name))
        yield from batches_of([(KEY, None, None, None, key, None, name, weight) for key, weight in cuts])


def first_tries(docs: DataFrame, held: int) -> DataFrame:
    """Rows settled in the scan's own tasks, the texts left open, and the keys of their tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = radix.Trie()
        for batch in batches:
            rows = []
            ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for doc, part, text in zip(ids, parts, common.texts(batch), strict=True):
                data = (text or "").encode()
                if doc is None:
                    rows.append(settled(None, part, text_mask(data, len(text or ""))))
                    continue
                node = trie.node(data)
                if node.record is None:
                    node.record = Record(text_mask(data, len(text or "")), doc, [part])
                else:
                    rows += [settled(d, p, node.record.mask | DUPLICATE) for d, p in node.record.meet(doc, [part])]
            yield from batches_of(rows)
            if trie.held > held:
                yield from left_open(trie, True)
                trie = radix.Trie()
        yield from left_open(trie, True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, ROWS)


def bounds_of(keys: DataFrame, parts: int) -> list[bytes]:
    """At most ``parts - 1`` bounds that cut the texts' bytes evenly: keys merged in ``MERGERS`` tasks, then on the driver."""
    most = MERGED * parts

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs = list(zip(table.column("text").to_pylist(), table.column("weight").to_pylist(), strict=True))
        cuts = radix.weighted_cuts(pairs, most, (key[0].as_py() + 1) / MERGERS) if len(pairs) > most else pairs
        return pa.table({"text": pa.array([k for k, _ in cuts], pa.binary()), "weight": pa.array([w for _, w in cuts], pa.int64())})

    merged = keys.select("text", "weight", F.pmod(F.xxhash64("trie"), F.lit(MERGERS)).alias("merger")).groupBy(
        "merger").applyInArrow(merge, "text binary, weight long")
    cuts = radix.weighted_cuts([(bytes(r.text), r.weight) for r in merged.collect()], parts)
    return sorted({k for k, _ in cuts[:-1]})


def range_tries(rows: DataFrame, bounds: list[bytes], held: int) -> DataFrame:
    """Open texts inserted into tries by range; the rows of each text's least id pass E, the others fail it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [bisect_right(bounds, t) for t in batch.column("text").to_pylist()]
            yield common.appended(batch, {"place": pa.array(places, pa.int32())})

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = radix.Trie(), None
        for batch in batches:
            rows = []
            for doc, mask, text, parts in common.rows_of([batch], "doc_id", "mask", "text", "parts"):
                if trie.held > held and text != last:  # texts come in order: the trie's texts do not come again
                    yield from passing(trie)
                    trie = radix.Trie()
                last, node = text, trie.node(text)
                if node.record is None:
                    node.record = Record(mask, doc, parts)
                else:
                    rows += [settled(d, p, mask | DUPLICATE) for d, p in node.record.meet(doc, parts)]
            yield from batches_of(rows)
        yield from passing(trie)

    def passing(trie: radix.Trie) -> Iterator[pa.RecordBatch]:
        yield from batches_of([settled(record.doc, p, record.mask) for _, record, _ in trie.walk() for p in record.parts])

    placed = rows.select("doc_id", "mask", "text", "parts").mapInArrow(
        place, "doc_id long, mask int, text binary, parts array<string>, place int")
    return placed.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("text").mapInArrow(insert, ROWS)


def document_masks(docs: DataFrame, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, part, mask (bit k set: fails the k-th filter)."""
    first = materialize(first_tries(docs, held), "audit-texts")
    parts = common.shuffle_parts(docs)
    bounds = bounds_of(first.where(F.col("kind") == KEY), common.shuffle_parts(docs))
    last = range_tries(first.where(F.col("kind") == OPEN), bounds, held)
    return first.unionByName(last).where(F.col("kind") == SETTLED).select("doc_id", "part", "mask")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and mask: all, good ones (quality 1) and toxic ones."""
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    # rows are summed by id first, so even a hot id, or null, brings few of them to the join
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad"))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from at most 32 masks a part."""
    steps = [{"filter_order": order, "step": k + 1, "own": 1 << FILTERS.index(f), "past": sum(1 << FILTERS.index(g) for g in order[:k])}
             for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, past: int>>")
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("masks")).select(
        "part", "masks", F.explode(listed).alias("s")).select("part", "masks", "s.*")
    own, past = F.col("own"), F.col("past")

    def total(keep, value):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(keep(m["mask"]), value(m)).otherwise(F.lit(0).cast("long")))

    def fails(m):
        return m.bitwiseAND(own) != 0

    def earlier(m):
        return m.bitwiseAND(past) != 0

    def removed(m):
        return fails(m) & ~earlier(m)

    def first(m):
        """In how many of the 120 orders one of the failed filters comes before the others."""
        return F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.bit_count(m))

    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~earlier(m), lambda m: m["n"]).alias("kept"),
        total(removed, lambda m: m["n"]).alias("removed"),
        total(lambda m: fails(m) & earlier(m), lambda m: m["n"]).alias("redundant"),
        total(lambda m: m == own, lambda m: m["n"]).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["bad"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * first(m["mask"])).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, by part, in all 120 orders."""
    return interactions(mask_counts(document_masks(docs), labels))


# DuckDB twin: failures by plain text functions, then every order and step over every document.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
lab AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS m,
    count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (bad = 1) AS bad
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT o, CAST(k AS INTEGER) AS step, bits[k] AS own, coalesce(list_sum(bits[1 : k - 1]), 0) AS past
  FROM orders, unnest(generate_series(1, 5)) AS s(k)),
sums AS (
  SELECT part, o AS filter_order, step, any_value(own) AS own,
    sum(n) FILTER (m & (own | CAST(past AS BIGINT)) = 0) AS kept,
    sum(n) FILTER (m & own != 0 AND m & CAST(past AS BIGINT) = 0) AS removed,
    sum(n) FILTER (m & own != 0 AND m & CAST(past AS BIGINT) != 0) AS redundant,
    sum(n) FILTER (m = own) AS unique_fails,
    sum(good) FILTER (m & own != 0 AND m & CAST(past AS BIGINT) = 0) AS good_lost,
    sum(bad) FILTER (m & own != 0 AND m & CAST(past AS BIGINT) = 0) AS toxic_lost
  FROM masks, steps GROUP BY part, o, step)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
