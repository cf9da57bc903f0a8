"""Packing: order-preserving windows by dynamic programming over document and sentence boundaries.

The documents' ids, in ascending ``doc_id`` order, form one stream per range of ids. A window may end after a
document (free), after a sentence (``sentence_cost`` tokens) or, in a stretch without sentence ends, every
``hard_step`` ids (``hard_cost``). The least total of padding and such costs follows from

    best[j] = min over i, end[j] - end[i] <= size, of best[i] + size - (end[j] - end[i]) + cost[j]

in which the minimum of ``best[i] + end[i]`` over a sliding span is kept in a monotone queue: one visit per
boundary. Work goes on ``span_ids`` ids at a time; the last ids of a span, up to a window, stay open for the
next. Those of a range are cut into powers of two, which need no padding.

Defined results: null and empty texts pack their end id. Null ids come first, repeated ids lie side by side; ids may
be any 64-bit numbers. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common, token_files, tokens

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def best_cuts(ends: list[int], costs: list[int], size: int) -> list[int]:
    """Ends of the cheapest windows over ``[0, ends[-1])``, whose last part, up to ``size`` ids, stays open and free.

    Consecutive ends are at most ``size`` apart.
    """
    at = [0, *ends]
    key, back = [0] * len(at), [0] * len(at)  # key: best + position
    queue, head = [0], 0
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[head]] > size:
            head += 1
        i = queue[head]
        back[j] = i
        value = key[j] = key[i] + size + costs[j - 1]  # best[j] + at[j] = (key[i] + size - at[j] + cost) + at[j]
        while len(queue) > head and key[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    stop = len(at) - 1
    first = next(i for i in range(stop, -1, -1) if not i or at[stop] - at[i - 1] > size)
    cuts, j = [], min(range(first, stop + 1), key=lambda i: key[i] - at[i])
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, sentence_cost: int, hard_cost: int,
               hard_step: int) -> tuple[list[int], list[int]]:
    """Candidate cut positions in order, and what a cut there costs."""
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    soft = np.union1d(sentences, doc_ends)
    gaps = np.diff(soft, prepend=0)
    hard = [np.arange(end - gap + hard_step, end, hard_step)
            for end, gap in zip(soft[gaps > hard_step], gaps[gaps > hard_step], strict=True)]
    at = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cost = np.full(len(at), hard_cost)
    cost[np.isin(at, sentences)] = sentence_cost
    cost[np.isin(at, doc_ends)] = 0
    return at.tolist(), cost.tolist()


def powers(length: int) -> list[int]:
    """``length`` as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Windows over one range's stream, fed document by document; ``rows`` holds finished pieces."""

    def __init__(self, part: int, ends_sentence: np.ndarray, size: int, sentence_cost: int, hard_cost: int,
                 hard_step: int, span_ids: int):
        self.ends_sentence, self.size, self.span = ends_sentence, size, max(span_ids, 4 * size)
        self.costs = (sentence_cost, hard_cost, min(hard_step, size))
        self.sequence = part << 32
        self.docs: list[tuple[int | None, int, np.ndarray]] = []  # doc_id, ids already packed, ids left
        self.held, self.rows = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids))
        self.held += len(ids)
        if self.held >= self.span:
            self._pack(last=False)

    def close(self) -> None:
        if self.docs:
            self._pack(last=True)

    def _pack(self, last: bool) -> None:
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        cuts = best_cuts(*boundaries(ids, ends, self.ends_sentence, *self.costs), self.size)
        begin, final = cuts[-1] if cuts else 0, int(ends[-1])
        if last:
            cuts += (begin + np.cumsum(powers(final - begin), dtype=np.int64)).tolist()
            begin = final
        self._emit(ids, ends, cuts, begin)
        k = int(np.searchsorted(ends, begin, side="right"))
        self.docs = [(d, done + max(0, begin - int(e - len(left))), left[max(0, begin - int(e - len(left))):])
                     for (d, done, left), e in zip(self.docs[k:], ends[k:], strict=True)]
        self.held = int(ends[-1]) - begin

    def _emit(self, ids: np.ndarray, ends: np.ndarray, cuts: list[int], stop: int) -> None:
        if not cuts:
            return
        data, opened = ids.astype("<u4").tobytes(), np.array([0, *cuts])
        points = np.union1d(opened, np.append(ends[ends < stop], stop))
        doc_at = np.searchsorted(ends, points[:-1], side="right")
        window = np.searchsorted(opened, points[:-1], side="right") - 1
        for a, b, d, w in zip(points[:-1].tolist(), points[1:].tolist(), doc_at.tolist(), window.tolist(), strict=True):
            doc_id, done, left = self.docs[d]
            self.rows.append((doc_id, done + a - int(ends[d]) + len(left), b - a, zlib.crc32(data[4 * a: 4 * b]),
                              done + len(left), self.sequence + w, a - int(opened[w])))
        self.sequence += len(cuts)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, sentence_cost: int = 8, hard_cost: int = 64,
         hard_step: int = 256, span_ids: int = 1 << 20) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the crc32 of its ids."""
    dtype = tokens.id_dtype(tokenizer, end_id).str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, ends_sentence = zstandard.ZstdDecompressor().decompress, tokens.sentence_ends(tokenizer)
        packer, now = None, None
        for part, doc, data in common.rows_of(batches, "part", "doc_id", "ids"):
            if part != now:
                if packer:
                    packer.close()
                    yield _table(packer)
                packer, now = Packer(part, ends_sentence, size, sentence_cost, hard_cost, hard_step, span_ids), part
            packer.add(doc, np.frombuffer(unpack(data), dtype))
            if len(packer.rows) >= 10_000:
                yield _table(packer)
        if packer:
            packer.close()
            yield _table(packer)

    return token_files.in_order(docs, tokenizer, end_id).mapInArrow(run, PIECES)


def _table(packer: Packer) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
    packer.rows = []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
