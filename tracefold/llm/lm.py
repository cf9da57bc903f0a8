"""LM scoring: stupid-backoff scores of every document against all other documents.

The n-gram counts of the whole corpus form one table, partitioned by n-gram hash; every document's n-grams are sent
to the partition that counts them, joined there, and their counts come back to be summed per document. Rows of
these relations are packed: documents are read into blocks of about ``block_words`` words (a block keeps its words
as 64-bit hashes, the commonest first, and the texts as places in that list), and one row carries all n-grams of a block that fall into
one hash partition, already counted within the block. So a frequent n-gram costs one entry a block, wherever its
occurrences are, and no text crosses the network. Blocks are written once, bucketed by their number, and wait there
for the counts. The number of partitions follows from the number of words.

Score. Words are ASCII-lower-cased and cut at blanks. With c the counts of the *other* documents' n-grams, N their
number of words, and m the highest order that fits at a position, the word scores ``ALPHA^(m-k) * c(k-gram) / c(its
context)`` at the highest order k <= m whose k-gram occurs elsewhere (the context of a single word is N), and
``ALPHA^m / (N + 1)`` if not even the word does. The document's log score is the sum of the logs.

Defined results: null, empty and blank texts have no words, log score 0 and a null mean. Copies count as other
documents, also repeated rows. An empty table gives no rows. Only ``doc_id`` and ``text`` are read. 64-bit hashes
stand for words and n-grams, so two of them are taken for one with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_by
from . import common

ALPHA = 0.4
CACHE_WORDS = 500_000
PART_GRAMS = 2_000_000
BLOCK = "block long, doc_ids array<long>, sizes array<long>, n_words long, words binary, places binary"
ASKED = "part int, block long, n int, grams binary, counts binary"
TOLD = "block long, n int, part int, counts binary"
SCORES = "doc_id long, n_words long, log_score double, mean_log_score double"


class Hashes(dict):
    """Cache: word -> XXH64. Emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def packed(values: np.ndarray) -> bytes:
    """Sorted or small integers, compressed: differences, byte planes, zstd."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    """Integers in any order, compressed: byte planes, zstd."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplain(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks_of(docs: DataFrame, block_words: int) -> DataFrame:
    """Documents as blocks of word hashes; only whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, name = Hashes(), TaskContext.get().partitionId() << 32
        ids, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, places, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small places for common words, sorted hashes among equally common ones
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, places = words[order], rank[places]
            return pa.RecordBatch.from_arrays([
                pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([held], pa.int64()), pa.array([packed(words)], pa.binary()), pa.array([plain(places)], pa.binary())],
                names=["block", "doc_ids", "sizes", "n_words", "words", "places"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                words = (text or "").encode().lower().split()
                ids.append(doc)
                sizes.append(len(words))
                parts.append(np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)))
                held += len(words)
                if held >= block_words:
                    yield flush()
                    name, ids, sizes, parts, held = name + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK)


class Sequence:
    """A block's words in order, with the n-grams ending at each position."""

    def __init__(self, sizes: list[int], words: bytes, places: bytes):
        self.sizes = np.array(sizes, dtype=np.int64)
        self.words = unpacked(words)[unplain(places)]
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.words)) - starts[self.doc]  # place in the document

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hashes of the n-grams ending at positions n-1 and on of their documents, 0 elsewhere), n = 1 to order."""
        now = self.words
        yield 1, now
        for n in range(2, order + 1):
            before = np.concatenate((np.zeros(1, np.uint64), now[:-1]))
            mixed = before * np.uint64(0x9E3779B97F4A7C15) + (self.words ^ (self.words >> np.uint64(31)))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            now = np.where(self.at >= n - 1, mixed ^ (mixed >> np.uint64(27)), np.uint64(0))
            yield n, now


def asked(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """One row per block, order and hash partition: the n-grams of the block that fall there, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sizes, words, places in common.rows_of(batches, "block", "sizes", "words", "places"):
            seq = Sequence(sizes, words, places)
            for n, grams in seq.grams(order):
                found, counts = np.unique(grams[seq.at >= n - 1], return_counts=True)
                part = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                if not len(cuts):
                    continue
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array([n] * len(cuts), pa.int32()),
                    pa.array([packed(found[a:b]) for a, b in spans], pa.binary()),
                    pa.array([plain(counts[a:b]) for a, b in spans], pa.binary())], names=["part", "block", "n", "grams", "counts"])

    return blocks.select("block", "sizes", "words", "places").mapInArrow(run, ASKED)


def told(requests: DataFrame) -> DataFrame:
    """The count table of each hash partition, joined back to what the blocks asked for."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for n in sorted(set(table.column("n").to_pylist())):
            rows = table.filter(pc.equal(table.column("n"), n))
            grams = [unpacked(g) for g in rows.column("grams").to_pylist()]
            counts = np.concatenate([unplain(c) for c in rows.column("counts").to_pylist()])
            _, back = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(back, weights=counts).astype(np.uint64)[back]
            ends = np.cumsum([len(g) for g in grams])
            out.append(pa.table({
                "block": rows.column("block"), "n": rows.column("n"), "part": rows.column("part"),
                "counts": pa.array([_wide(total[e - len(g): e]) for g, e in zip(grams, ends.tolist(), strict=True)], pa.binary())}))
        return pa.concat_tables(out)

    return requests.groupBy("part").applyInArrow(run, TOLD)


def _wide(values: np.ndarray) -> bytes:
    """Counts of any size, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unwide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def spans(docs: np.ndarray, size: int = 250_000) -> Iterator[tuple[int, int]]:
    """Spans of about ``size`` places that hold whole documents; ``docs`` is sorted."""
    at = 0
    while at < len(docs):
        end = len(docs) if at + size >= len(docs) else int(np.searchsorted(docs, docs[at + size]))
        if end <= at:
            end = int(np.searchsorted(docs, docs[at], side="right"))
        yield at, end
        at = end


def block_scores(seq: Sequence, counts: dict[int, np.ndarray], order: int, words: int) -> np.ndarray:
    """Log score of every document of a block; ``counts[n]`` are the corpus counts of its n-grams, in hash order."""
    others = (words - seq.sizes)[seq.doc].astype(float)  # words of the other documents, by position
    most = np.minimum(seq.at + 1, order)
    value = most * np.log(ALPHA) - np.log(others + 1)
    context = others
    for n, grams in seq.grams(order):
        fits = np.flatnonzero(seq.at >= n - 1)
        elsewhere = np.zeros(len(grams))
        found, back = np.unique(grams[fits], return_inverse=True)
        for a, b in spans(seq.doc[fits]):
            _, own, own_counts = np.unique(seq.doc[fits[a:b]] * len(found) + back[a:b], return_inverse=True, return_counts=True)
            elsewhere[fits[a:b]] = counts[n][back[a:b]].astype(float) - own_counts[own]
        seen = elsewhere > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen, (most - n) * np.log(ALPHA) + np.log(elsewhere) - np.log(context), value)
        context = np.concatenate(([0.0], elsewhere[:-1]))
    return np.bincount(seq.doc, weights=value, minlength=len(seq.sizes))


def stupid_backoff(docs: DataFrame, order: int = 3, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document against all others."""
    blocks = materialize_by(blocks_of(docs, block_words), "lm-blocks", "block", common.shuffle_parts(docs))
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(int(np.ceil(np.log2(max(words * order / PART_GRAMS, common.shuffle_parts(docs), 1)))), 0)
    replies = told(asked(blocks, order, bits))

    def run(key: tuple, block: pa.Table, reply: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0].as_py() for c in ("doc_ids", "sizes", "words", "places")}
        seq = Sequence(row["sizes"], row["words"], row["places"])
        by_order: dict[int, list[tuple[int, bytes]]] = {n: [] for n in range(1, order + 1)}
        for n, part, data in zip(*(reply.column(c).to_pylist() for c in ("n", "part", "counts")), strict=True):
            by_order[n].append((part, data))
        counts = {n: np.concatenate([np.empty(0, np.uint64), *[_unwide(d) for _, d in sorted(rows)]]) for n, rows in by_order.items()}
        scores = block_scores(seq, counts, order, words)
        sizes = np.array(row["sizes"])
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(sizes, pa.int64()),
                         "log_score": pa.array(scores, pa.float64()),
                         "mean_log_score": pa.array(scores / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORES)


# DuckDB twin: order 3, counts of all documents less the document's own.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM d, unnest(generate_series(1, len(ws))) AS x(i)),
t AS (SELECT count(*) AS n FROM p),
sizes AS (SELECT r, count(*) AS n FROM p GROUP BY r),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
o1 AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
o3 AS (SELECT r, u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY r, u, v, w),
e AS (
  SELECT p.r, 1 + CAST(p.v IS NOT NULL AS INTEGER) + CAST(p.u IS NOT NULL AS INTEGER) AS most, c1.c - o1.c AS one, c2.c - o2.c AS pair,
    c3.c - o3.c AS triple, k1.c - q1.c AS context, k2.c - q2.c AS context2, t.n - sizes.n AS others
  FROM p CROSS JOIN t JOIN sizes USING (r) JOIN c1 ON c1.w = p.w JOIN o1 ON o1.r = p.r AND o1.w = p.w
  LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN o2 ON o2.r = p.r AND o2.v = p.v AND o2.w = p.w
  LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
  LEFT JOIN o3 ON o3.r = p.r AND o3.u = p.u AND o3.v = p.v AND o3.w = p.w
  LEFT JOIN c1 AS k1 ON k1.w = p.v LEFT JOIN o1 AS q1 ON q1.r = p.r AND q1.w = p.v
  LEFT JOIN c2 AS k2 ON k2.v = p.u AND k2.w = p.v LEFT JOIN o2 AS q2 ON q2.r = p.r AND q2.v = p.u AND q2.w = p.v),
s AS (
  SELECT r, count(*) AS n, sum(CASE
    WHEN triple > 0 THEN ln(triple) - ln(context2)
    WHEN pair > 0 THEN (most - 2) * ln(0.4) + ln(pair) - ln(context)
    WHEN one > 0 THEN (most - 1) * ln(0.4) + ln(one) - ln(others)
    ELSE most * ln(0.4) - ln(others + 1) END) AS total FROM e GROUP BY r)
SELECT doc_id, coalesce(s.n, 0) AS n_words, round(coalesce(total, 0), 4) AS log_score, round(total / s.n, 6) AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""
