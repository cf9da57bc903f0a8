"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Every statistic is cut into at most ``BINS`` bins at its quantiles. Boosting goes round the features: each visit
fits a depth-two tree to that one feature's gradient histogram and adds a small step to the feature's lookup
table. Then the pairs whose coarse grids explain most of what is left are boosted in turn in the same way, with
depth-two trees that split both features. A score is the logistic of the sum of one entry per table, looked up
for many documents at once.

The model is fitted on all labelled rows. They are dealt by a hash into groups of about ``rows``; each group gives
its quantiles, whose means are the bin edges of all groups, then its own tables, boosted in its own task, and the
model has the means of these. Only edges and tables, of fixed size per group, reach the driver. Statistics are
computed before labels are joined, so no text crosses the network.

Defined results: a null text is an empty one; both get all-zero statistics and the model's score for them. Rows
without a label teach nothing; with one class only, every score is that class; with no labels it is 0.5.
Repeated rows score alike. Clashing columns are replaced.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import common

BINS = 32
COARSE = 8
FEATURES = ["bytes_log", "words_log", "word_bytes", "word_bytes_spread", "upper", "digits", "stops", "commas", "marks",
            "pipes", "symbols", "non_ascii", "distinct", "commonest", "same_next", "lines_log", "line_words",
            "distinct_lines", "short_words", "long_words"]


def statistics(text: str | None) -> list[float]:
    """The numbers that FEATURES names, of a whole text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    punctuation = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
    stops, commas, marks, pipes = byte[46], byte[44], byte[33] + byte[63], byte[124]
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(),
        byte[65:91].sum() / size, byte[48:58].sum() / size, stops / n, commas / n, marks / n, pipes / n,
        (punctuation - stops - commas - marks - pipes) / n, byte[128:].sum() / size,
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
        (lengths <= 2).mean(), (lengths >= 16).mean()]


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def split(g: np.ndarray, h: np.ndarray) -> int:
    """The first bin of the right side of the best cut of a histogram (0: none is worth it)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0
    won = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
    best = int(np.argmax(won))
    return best + 1 if won[best] > 1e-9 else 0


def tree_1d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A depth-two tree on one feature's bins: the step of every bin."""
    out, cut = np.empty(len(g)), split(g, h)
    for a, b in ((0, cut), (cut, len(g))):
        if a < b:
            mid = a + split(g[a:b], h[a:b])
            for lo, hi in ((a, mid), (mid, b)):
                if lo < hi:
                    out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best depth-two tree on a pair's grid: a cut on one feature, then each side cut on the other."""
    best, won = np.full(g.shape, -g.sum() / (h.sum() + 1.0)), gain(g.sum(), h.sum())
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            step, total = np.empty(a.shape), 0.0
            for lo, hi in ((0, cut), (cut, len(a))):
                ga, ha = a[lo:hi].sum(axis=0), b[lo:hi].sum(axis=0)
                mid = split(ga, ha)
                for p, q in ((0, mid), (mid, len(ga))):
                    if p < q:
                        step[lo:hi, p:q] = -ga[p:q].sum() / (ha[p:q].sum() + 1.0)
                        total += gain(ga[p:q].sum(), ha[p:q].sum())
            if total > won:
                best, won = (step.T if turn else step), total
    return best


@dataclass(frozen=True)
class Model:
    """Intercept, bin edges, a lookup table per feature, and one per pair of features."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    coarse: tuple[np.ndarray, ...]
    grids: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], side="right")]
        for (a, b), t in zip(self.pairs, self.grids, strict=True):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def constant(p: float) -> Model:
    return Model(float(np.log(p / (1 - p))), (), (), (), (), ())


def cuts(x: np.ndarray) -> np.ndarray:
    """The quantiles of every feature that its edges are made of, fine ones then coarse ones."""
    return np.concatenate([np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], axis=0) for n in (BINS, COARSE)])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1,
          at: np.ndarray | None = None) -> Model:
    """Fit the tables by cyclic boosting of the log loss; ``at`` are other rows' quantiles too (``cuts``)."""
    at = cuts(x) if at is None else at
    cut = [np.unique(at[:BINS - 1, k]) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(cut)]
    tables = [np.zeros(len(e) + 1) for e in cut]
    p = np.clip(y.mean(), 0.5 / len(y), 1 - 0.5 / len(y))  # a group may have one class only
    intercept = float(np.log(p / (1 - p)))
    z = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            g, h = slopes()
            m = len(tables[k])
            step = rate * tree_1d(np.bincount(b, g, m), np.bincount(b, h, m))
            tables[k] += step
            z += step[b]
    coarse = [np.unique(at[BINS - 1:, k]) for k in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    g, h = slopes()

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(rough[a] * shape[1] + rough[b], v, shape[0] * shape[1]).reshape(shape)

    left = {(a, b): gain(grid(a, b, g), grid(a, b, h)).sum() for a, b in combinations(range(x.shape[1]), 2)}
    chosen = sorted(left, key=lambda p: (-left[p], p))[:pairs]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), t in zip(chosen, grids, strict=True):
            g, h = slopes()
            step = rate * tree_2d(grid(a, b, g), grid(a, b, h))
            t += step
            z += step[rough[a], rough[b]]
    return Model(intercept, tuple(cut), tuple(tables), tuple(chosen), tuple(coarse), tuple(grids))


def mean(models: list[Model], rows: list[int]) -> Model:
    """The model whose logit is the mean of the models', by their rows: they share their edges, so tables add up."""
    share, first = np.array(rows) / sum(rows), models[0]
    tables = tuple(sum(w * m.tables[k] for w, m in zip(share, models, strict=True)) for k in range(len(first.tables)))
    grids: dict[tuple[int, int], np.ndarray] = {}
    for w, m in zip(share, models, strict=True):
        for pair, t in zip(m.pairs, m.grids, strict=True):
            grids[pair] = grids.get(pair, 0) + w * t
    intercept = float(sum(w * m.intercept for w, m in zip(share, models, strict=True)))
    return Model(intercept, first.edges, tables, tuple(grids), first.coarse, tuple(grids.values()))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Model:
    """Fit on all texts that ``labels`` (doc_id, quality) names, in groups of about ``rows``."""
    known = common.known_labels(labels, "quality", (0, 1))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return constant({(): 0.5, (0,): 1e-9, (1,): 1 - 1e-9}[tuple(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kept = docs.select("doc_id", "text")
    measured = kept.mapInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    groups = -(-sum(n.values()) // rows)
    found = materialize(measured.join(known, "doc_id").select(
        F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(groups)).alias("part"), F.col("label").alias("y"), "x"), "quality-rows")
    kinds = {r.y for r in found.select("y").distinct().collect()}
    if len(kinds) < 2:
        return constant({(): 0.5, (0,): 1e-9, (1,): 1 - 1e-9}[tuple(kinds)])

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A group's statistics and labels, in an order of their own."""
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        y = table.column("y").to_numpy().astype(float)
        order = np.lexsort((*x.T[::-1], y))
        return x[order], y[order]

    def quantiles(table: pa.Table) -> pa.Table:
        return pa.table({"n": [table.num_rows], "at": [cuts(arrays(table)[0]).ravel().tolist()]})

    told = found.groupBy("part").applyInArrow(quantiles, "n long, at array<double>").collect()
    told.sort(key=lambda r: (r.n, r["at"]))
    first = np.array(told[0]["at"])  # what all groups have in common stays as it is, to the last bit
    at = first + sum(r.n * (np.array(r["at"]) - first) for r in told) / sum(r.n for r in told)
    at = at.reshape(-1, len(FEATURES))

    def tables(table: pa.Table) -> pa.Table:
        return pa.table({"n": [table.num_rows], "model": [pickle.dumps(boost(*arrays(table), at=at))]})

    made = sorted(map(tuple, found.groupBy("part").applyInArrow(tables, "n long, model binary").collect()))
    return mean([pickle.loads(m) for _, m in made], [n for n, _ in made])


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), from ``text`` alone."""
    kept, schema = common.extended(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in common.texts(batch)]).reshape(-1, len(FEATURES))
            out = shared.value.scores(x)
            yield common.appended(batch, {"score": pa.array(out, pa.float64()),
                                          "predicted": pa.array((out >= threshold).astype(np.int32), pa.int32())})

    return kept.mapInArrow(run, schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """The labels (or documents) that a model may learn from: two of three folds of the ids."""
    return labels.where(common.fold("doc_id", 3) != 1)
