"""Language ID by error-correcting output codes over hashed character n-grams.

Every language gets a binary codeword; one logistic model per bit predicts that bit from a text's n-gram
profile (1 to 3 letters, hashed to ``features`` columns, blanks marking word ends). A text goes to the language
whose codeword has the least total logistic loss against the bits' margins. ``score`` is the winner's share of
``exp(-loss)`` over all codewords, and ``ambiguous`` says that the runner-up came closer than ``margin`` per bit.

Codes: with up to 7 languages the exhaustive code (every way to split them in two), with more 15 * log2(n)
columns picked by their least distance among random ones (seeded).

Models are fitted on a bounded sample: about ``per_language`` documents of each language, chosen by a hash. Their
profiles are computed by Spark; at most ``per_language * languages`` sparse profiles reach the driver.

Defined results: a null text or one without a letter is ``und`` with score 0, ambiguous. Rows without a language
teach nothing; with no language at all every text is ``und``; with one language every text with a letter is that
language. Repeated rows are scored alike. Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
BLOCK_WORDS = 200_000
# Odd multipliers that spread code points over the profile's columns (any such numbers do).
SPREAD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def profile(text: str | None, features: int) -> np.ndarray | None:
    """Share of each hashed letter n-gram, square-rooted; None without a letter. Long texts are counted in blocks."""
    words = LETTERS.findall((text or "").lower())
    if not any(any(map(str.isalpha, w)) for w in words):  # the pattern also takes numerals such as ² and Ⅷ
        return None
    total, shift = np.zeros(features), np.uint32(32 - (features.bit_length() - 1))
    tail = ""  # the letters before a block, which its first n-grams begin with
    for at in range(0, len(words), BLOCK_WORDS):
        marked = f"{tail}{'' if at else ' '}{' '.join(words[at: at + BLOCK_WORDS])} "
        chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        mixed = chars * SPREAD[0]
        total += np.bincount(mixed[len(tail):] >> shift, minlength=features)
        for k in (1, 2):
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * SPREAD[k] + chars[k:]
            mixed = mixed * SPREAD[0]
            total += np.bincount(mixed[max(0, len(tail) - k):] >> shift, minlength=features)
        tail = marked[-2:]
    return np.sqrt(total / total.sum()).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """One row of -1/+1 bits per language."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        columns = np.arange(1, 1 << (languages - 1))
        bits = (columns[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits, 1.0, -1.0)
    rng, width = np.random.default_rng(languages), int(np.ceil(15 * np.log2(languages)))
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, width))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + width * np.eye(languages, dtype=int)
        if apart.min() > gap and (np.abs(code.sum(axis=0)) < languages).all():
            best, gap = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, and one column of weights (and an intercept) per bit."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def losses(self, profiles: np.ndarray) -> np.ndarray:
        """Mean logistic loss of every codeword, a row per profile."""
        margins = profiles @ self.weights + self.intercept
        return np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).mean(axis=2)

    def decide(self, profiles: np.ndarray, margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        losses = self.losses(profiles)
        order = np.sort(losses, axis=1)
        share = np.exp(-self.code.shape[1] * (losses - order[:, :1]))
        gap = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        return [self.languages[k] for k in losses.argmin(axis=1)], 1 / share.sum(axis=1), gap < margin


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the -1/+1 columns of ``y`` on ``x``, all at once, by Nesterov's accelerated descent.

    The last column of ``x`` is 1 and gets the intercepts.
    """
    top = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # power iteration: the step is one over the gradient's Lipschitz constant
        top = x.T @ (x @ (top / np.linalg.norm(top))) / len(x)
    step = np.float32(1 / (np.linalg.norm(top) / 4 + ridge))
    w = ahead = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for k in range(steps):
        pull = (-y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))).astype(np.float32)
        before, w = w, ahead - step * (x.T @ pull / len(x) + np.float32(ridge) * ahead)
        ahead = w + np.float32(k / (k + 3)) * (w - before)
    return w[:-1], w[-1]


def fit(labelled: DataFrame, per_language: int = 1500, features: int = 4096) -> Model:
    """Fit the bits on a bounded sample of (text, lang); rows of ``labelled`` beyond it are only counted.

    About ``per_language`` different texts of each language are picked, by a hash of the text, and copies count once:
    a language that is mostly copies still learns from its other texts, and no more than these texts reach the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros((features, 1)), np.zeros(1))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_language / max(n, 1)))])
    picked = known.where(F.pmod(F.xxhash64(F.lit("langid"), "text"), F.lit(1 << 31)) < share[F.col("lang")] * (1 << 31)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, p) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    if (p := profile(t, features)) is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang for lang, _ in rows], pa.string()),
                pa.array([p.astype(np.float16).tobytes() for _, p in rows], pa.binary())], names=["lang", "profile"])

    table = picked.mapInArrow(run, "lang string, profile binary").toArrow()
    x = np.ones((table.num_rows, features + 1), np.float32)
    for i, p in enumerate(table.column("profile")):
        x[i, :-1] = np.frombuffer(p.as_buffer(), np.float16)
    code = codewords(len(languages))
    y = code[[languages.index(lang) for lang in table.column("lang").to_pylist()]].reshape(-1, code.shape[1])
    return Model(languages, code, *logistic(x, y))


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
         T.StructField("ambiguous", T.BooleanType())]


def identify(docs: DataFrame, model: Model, margin: float = 0.02) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from ``text`` alone."""
    kept, schema = common.extended(docs, ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features * bits numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = m.weights.shape[0]
        for batch in batches:
            n = batch.num_rows
            langs, scores, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
            for at in range(0, n, 1024):
                texts = batch.column("text").slice(at, 1024).to_pylist()
                found = [(at + i, p) for i, t in enumerate(texts) if m.languages and (p := profile(t, features)) is not None]
                if not found:
                    continue
                rows = [i for i, _ in found]
                names, scores[rows], unsure[rows] = m.decide(np.array([p for _, p in found]), margin)
                for i, name in zip(rows, names, strict=True):
                    langs[i] = name
            yield common.appended(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()),
                                          "ambiguous": pa.array(unsure, pa.bool_())})

    return kept.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn languages from: four of five folds of the ids."""
    return docs.where(common.fold("doc_id", 5) != 0).select("text", "lang")
