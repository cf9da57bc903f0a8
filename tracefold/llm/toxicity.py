"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Words are what is between blanks and ASCII digits. One over ``LONGEST`` letters or in a script without blanks is read
as windows of ``WINDOW`` letters from each place on, each a word. Two models of order ``ORDER`` read every word letter by letter between word marks:
one of toxic, one of ordinary training texts. Both back off, at every history, to one Kneser-Ney model of the two classes' pooled
counts, with absolute discounting and ``PULL`` pseudo-counts. An expression that is rare in both classes thus
has nearly the same chance in both and tells nothing. The pooled chance cancels where a class has not seen the
n-gram, so a model is kept as the log ratio of every n-gram seen and of every history's backoff weights.

A text's evidence is the length-normalised log-likelihood ratio (mean over its words), with its strongest word,
the mean excess of its clear words and their number, so long texts with a few such words are not washed out. A
logistic curve, fitted on training texts that the n-gram models have not seen, turns it into the score.

The models are fitted on all labelled texts: two of three, by a hash, for the n-grams, the others for the curve. Spark
counts the words and the n-grams of the distinct ones; n-grams that occur once in all are left out (they back off). The
curve's Newton steps are sums over the rows that Spark adds up. The driver gets the n-grams, as many as the vocabulary
has, and a few sums per step; no row per text.

Defined results: null, empty and blank texts and those of digits alone score 0. Rows without a label teach nothing; with no toxic or no
ordinary text to learn from every score is 0 (only ordinary or no labels) or 1 (only toxic ones). Repeated rows
score alike. Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import common

ORDER = 6
SHARED = 1
MARK = "\x02"  # before and after a word
LONGEST = 40  # letters of a word; what is longer is read in windows
WINDOW = 8
CACHE_WORDS = 400_000
DIGIT = re.compile("[0-9]+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts without blanks
HELD_WORDS = 200_000  # words of texts that are looked at together
CLEAR = 1.0  # nats that a word must give to speak for the toxic class
DISCOUNT = 0.75
PULL = 20.0  # pseudo-counts of the shared model at every history
BASE = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """What is between blanks and digits, so that letters beside a digit still speak; in windows where blanks do not part words."""
    text = DIGIT.sub(" ", (text or "").lower())
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST and not UNSPACED.search(text):
        return words
    return [p for w in words for p in windows(w)]


def windows(word: str) -> list[str]:
    """A word, or the letters from each place on of what is no single word, so that an expression in it begins one."""
    if len(word) <= WINDOW or len(word) <= LONGEST and not UNSPACED.search(word):
        return [word]
    return [word[i: i + WINDOW] for i in range(len(word))]


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between marks, and the index of the word each belongs to."""
    marked = [f"{MARK}{w}{MARK}" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return chars, np.repeat(np.arange(len(words)), [len(m) for m in marked])


def keys(chars: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram of ``order`` ending at each position, and whether it lies within one word."""
    key, inside = np.zeros(len(chars), np.uint64), np.ones(len(chars), dtype=bool)
    for back in range(order - 1, -1, -1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[back:] = chars[: max(0, len(chars) - back)]
        key = key * BASE + shifted + np.uint64(1)
        if back:
            inside[:back] = False
            inside[back:] &= owner[back:] == owner[:-back]
    key = key ^ (key >> np.uint64(29))
    return key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order), inside


@dataclass(frozen=True)
class Grams:
    """Log ratios by sorted key: of n-grams seen, and of the backoff weights of histories seen, per order."""

    gram_keys: tuple[np.ndarray, ...]
    gram_ratio: tuple[np.ndarray, ...]
    history_keys: tuple[np.ndarray, ...]
    history_ratio: tuple[np.ndarray, ...]

    @cached_property
    def places(self) -> tuple[tuple["Places", ...], ...]:
        return tuple(tuple(map(Places, tables)) for tables in (self.gram_keys, self.history_keys))

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio, toxic to ordinary, of each word (sum over its letters and end mark)."""
        if not words:
            return np.zeros(0)
        gram_places, history_places = self.places
        chars, owner = letters(words)
        ratio = np.zeros(len(chars))
        before, _ = keys(chars, owner, SHARED)
        for k, order in enumerate(range(SHARED + 1, ORDER + 1)):
            gram, inside = keys(chars, owner, order)
            history, before = np.concatenate(([np.uint64(0)], before[:-1])), gram
            below, there = history_places[k].find(history)
            seen, at = gram_places[k].find(gram)
            ratio = np.where(seen & inside, self.gram_ratio[k][at] if len(at) else 0.0,
                             np.where(below & inside, self.history_ratio[k][there], ratio))
        return np.bincount(owner, weights=ratio, minlength=len(words))


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where (a table without keys gets one place that never matches)."""
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[at] == wanted, at


class Places:
    """A sorted table of spread keys, looked up by their first bits: ``find`` in a few steps a key, whatever its length."""

    def __init__(self, table: np.ndarray):
        self.table, bits = table, max(int(len(table)).bit_length() + 1, 1)
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = (np.cumsum(counts) - counts).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the table, and where."""
        at = np.minimum(self.start[(wanted >> self.shift).astype(np.int64)], len(self.table) - 1)
        found = self.table[at] == wanted
        left = np.flatnonzero(~found)
        for _ in range(self.longest - 1):
            # the table is sorted: a greater key ends the search
            left = left[self.table[at[left]] < wanted[left]]
            at[left] = np.minimum(at[left] + 1, len(self.table) - 1)
            found[left] = self.table[at[left]] == wanted[left]
        return found, at


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Counter, Counter]]:
    """Counts of the words of ordinary and of toxic texts, about ``HELD_WORDS`` distinct words at a time."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(common.texts(batch), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(words_of(text))
            if len(seen[0]) + len(seen[1]) > HELD_WORDS:
                yield seen
                seen = (Counter(), Counter())
    if seen[0] or seen[1]:
        yield seen


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, t, o): how often every word occurs in the toxic and in the ordinary texts of (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ordinary, toxic in counted_words(batches):
            words = list(ordinary | toxic)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[
                pa.array([c[w] for w in words], pa.int64()) for c in (toxic, ordinary)]], names=["word", "t", "o"])

    return labelled.select("text", "toxic").mapInArrow(run, "word string, t long, o long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))


def count_grams(labelled: DataFrame, least: int = 2) -> DataFrame:
    """(n, key, history, suffix, t, o): toxic and ordinary counts of every n-gram of the words of (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.grouped(batches, 2 << 20):
            words = batch.column("word").to_pylist()
            chars, owner = letters(words)
            weights = [batch.column(c).to_numpy().astype(float)[owner] for c in ("t", "o")]
            below = np.zeros(len(chars), np.uint64)
            for order in range(1, ORDER + 1):
                key, inside = keys(chars, owner, order)
                found, first, back = np.unique(key[inside], return_index=True, return_inverse=True)
                at = np.flatnonzero(inside)
                history = np.concatenate(([np.uint64(0)], below[:-1]))
                t, o = (np.bincount(back, weights=w[at]).astype(np.int64) for w in weights)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found), order), pa.int32()), *[pa.array(x.view(np.int64), pa.int64()) for x in
                    (found, history[at][first], below[at][first])], pa.array(t), pa.array(o)],
                    names=["n", "key", "history", "suffix", "t", "o"])
                below = key

    counted = count_words(labelled).mapInArrow(run, "n int, key long, history long, suffix long, t long, o long")
    return counted.groupBy("n", "key").agg(F.min("history").alias("history"), F.min("suffix").alias("suffix"),
                                           F.sum("t").alias("t"), F.sum("o").alias("o")).where(F.col("t") + F.col("o") >= least)


def kneser_ney(table: np.ndarray) -> Grams:
    """The two models from the columns of ``count_grams``, as log ratios."""
    never = np.full(1, np.iinfo(np.uint64).max)
    grams, pooled, chance = [], np.empty(0, np.uint64), np.empty(0)
    for order in range(1, ORDER + 1):
        rows = table[table[:, 0] == order]
        rows = rows[np.argsort(np.ascontiguousarray(rows[:, 1]).view(np.uint64))]
        key, history, suffix = (np.ascontiguousarray(rows[:, k]).view(np.uint64) for k in (1, 2, 3))
        c = rows[:, 4:6].astype(float)
        # below the highest order the pooled model counts an n-gram by the letters before it (none: how often it opens a word)
        longer = table[table[:, 0] == order + 1]
        after, kinds = np.unique(np.ascontiguousarray(longer[:, 3]).view(np.uint64), return_counts=True)
        both = c.sum(axis=1)
        if order < ORDER and len(after) and len(key):
            ahead, at = find(after, key)
            both = np.where(ahead, kinds[at], both)
        found, group = np.unique(history, return_inverse=True)
        total, many = np.bincount(group, weights=both), np.bincount(group)
        below = np.full(len(key), 1.0 / max(len(key), 1))
        if order > 1 and len(pooled) and len(key):
            has, at = find(pooled, suffix)
            below = np.where(has, chance[at], chance.min())
        if len(key):
            p = (np.maximum(both - DISCOUNT, 0) + DISCOUNT * many[group] * below) / total[group]
        else:
            p = np.empty(0)
        if order > SHARED and len(key):
            n = np.stack([np.bincount(group, weights=c[:, k]) for k in (0, 1)], axis=1)
            kind = np.stack([np.bincount(group, weights=c[:, k] > 0) for k in (0, 1)], axis=1)
            weight = (DISCOUNT * kind + PULL) / (n + PULL)
            pc = np.maximum(c - DISCOUNT, 0) / (n[group] + PULL) + weight[group] * p[:, None]
            grams.append((key, np.log(pc[:, 0] / pc[:, 1]), found, np.log(weight[:, 0] / weight[:, 1])))
        elif order > SHARED:
            grams.append((never, np.zeros(1), never, np.zeros(1)))
        pooled, chance = key, p
    return Grams(*[tuple(g[k] for g in grams) for k in range(4)])


class Evidence(dict):
    """Cache: word -> log-likelihood ratio. Emptied when full."""

    def __init__(self, grams: Grams, limit: int = CACHE_WORDS):
        super().__init__()
        self.grams, self.limit = grams, limit

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Per text: mean, highest, mean excess of clear words, number of clear words, number of words."""
        out, split, held = [np.zeros((0, 5))], [], 0
        for text in texts:
            split.append(words_of(text))
            held += len(split[-1])
            if held > HELD_WORDS:
                out.append(self.of_words(split))
                split, held = [], 0
        return np.concatenate([*out, self.of_words(split)])

    def of_words(self, split: list[list[str]]) -> np.ndarray:
        fresh = list({w for ws in split for w in ws if w not in self})
        if len(self) + len(fresh) > self.limit:
            self.clear()
            fresh = list({w for ws in split for w in ws})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at: at + 20_000]
            self.update(zip(part, self.grams.evidence(part).tolist(), strict=True))
        out = np.zeros((len(split), 5))
        for i, ws in enumerate(split):
            if ws:
                values = np.array([self[w] for w in ws])
                clear = values[values > CLEAR]
                out[i] = values.mean(), values.max(), (clear - CLEAR).sum() / len(ws), len(clear), len(ws)
        return out


def shaped(evidence: np.ndarray) -> np.ndarray:
    """The curve's inputs, bounded or on log scales."""
    mean, highest, excess, clear, words = evidence.T
    return np.column_stack([mean.clip(-2, 2), highest.clip(-2, 8) / 4, np.log(excess + 1e-3) + 7, np.log1p(clear), np.log1p(words)])


@dataclass(frozen=True)
class Model:
    """The n-gram log ratios, the logistic curve's weights (intercept last), and the score without a model."""

    grams: Grams | None
    weights: np.ndarray
    constant: float

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        z = np.column_stack([shaped(evidence), np.ones(len(evidence))]) @ self.weights
        return np.where(evidence[:, 4] > 0, 1 / (1 + np.exp(-z.clip(-30, 30))), 0.0)


def curve(rows: DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps on all of (toxic, mean, highest, excess, clear, words); a step's sums come from Spark."""
    w = np.zeros(6)
    for _ in range(50):
        n, grad, hessian = slopes(rows, w)
        if not n:
            break
        step = np.linalg.solve(hessian + ridge * n * np.eye(len(w)), grad + ridge * n * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def slopes(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """How many rows, and the log loss's gradient and second derivatives at ``w``: one row of sums per batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + len(w) + len(w) ** 2)
        for batch in batches:
            y, *e = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([shaped(np.column_stack(e)), np.ones(len(y))])
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            sums += np.concatenate([[len(y)], x.T @ (p - y), ((x.T * (p * (1 - p))) @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select("toxic", "mean", "highest", "excess", "clear", "words").mapInArrow(run, "sums array<double>")
    # of many tasks' rows one comes to the driver
    total = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    sums = np.array([r.s for r in total]) if total else np.zeros(1 + len(w) + len(w) ** 2)
    return float(sums[0]), sums[1: 1 + len(w)], sums[1 + len(w):].reshape(len(w), len(w))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all texts that ``labels`` (doc_id, toxic) names."""
    apart = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(3)) == 0

    known = common.known_labels(labels, "toxic", (0, 1))
    kinds = {r.label for r in known.select("label").distinct().collect()}
    if len(kinds) < 2:
        return Model(None, np.zeros(6), float(1 in kinds))

    def texts(which: Column) -> DataFrame:
        """The labelled texts of one part; each text is shuffled for its part only."""
        rows = common.labelled(docs.select("doc_id", "text").where(which), known.where(which))
        return rows.select("text", F.col("label").alias("toxic"))

    grams = kneser_ney(common.collected(count_grams(texts(~apart))))
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Evidence(shared.value)
        for batch in batches:
            e = cache.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(e[:, k]) for k in range(5)]],
                                             names=["toxic", "mean", "highest", "excess", "clear", "words"])

    rows = materialize(texts(apart).mapInArrow(
        run, "toxic int, mean double, highest double, excess double, clear double, words double"), "toxicity-evidence")
    return Model(grams, curve(rows), 0.0)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), from ``text`` alone."""
    kept, schema = common.extended(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary's n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = Evidence(m.grams) if m.grams else None
        for batch in batches:
            out = np.full(batch.num_rows, m.constant)
            for at in range(0, batch.num_rows if cache is not None else 0, 512):
                out[at: at + 512] = m.scores(cache.of(batch.column("text").slice(at, 512).to_pylist()))
            yield common.appended(batch, {"score": pa.array(out, pa.float64()),
                                          "predicted": pa.array((out >= threshold).astype(np.int32), pa.int32())})

    return kept.mapInArrow(run, schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """The labels (or documents) that a model may learn from: three of four folds of the ids."""
    return labels.where(common.fold("doc_id", 4) != 2)
