"""SimHash near-duplicates: fingerprints, links within a bit distance, and connected components.

A text's fingerprint has bit b set if over half of its word shingles' XXH64 hashes have it set. Links between
fingerprints at most ``distance`` bits apart are found by the general pigeonhole principle: the 64 bits are cut
into m groups of correlated bits; group i gets a threshold t[i] >= -1 with sum(t) = distance - m + 1. Two
fingerprints within ``distance`` then agree within t[i] bits in some group i with t[i] >= 0 (if they did not,
they would differ in at least sum(t[i] + 1) = distance + 1 bits). Dynamic programming chooses the thresholds,
and m, by the estimated number of probes and candidates, from the bits' counts over all fingerprints.

Probing a group: every fingerprint is filed under its group value; with a threshold above 0 it is also sent to
all values within that many bits. Candidates are verified on all 64 bits. A group value held by more than
``dense`` fingerprints is not paired. Its holders are linked over midpoints instead: two words within 2r bits
have a word within r bits of both, so each holder (and, for odd distances, each holder's ball of the next
radius) is filed under all words within r bits of it, and the holders of one word are linked to the least.
That is exact and linear, so a group of near copies of any size never forms all pairs.

Everything runs on distinct fingerprints, so exact copies collapse before any link is sought.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; a text with fewer
words than a shingle has one shingle of all its words. Repeated rows and ties share a component. A component's
id is its least ``doc_id``; null ids are ignored (null if there is no other). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import common
from .components import star_components

SEED = 42
BLOCK_SHINGLES = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    n = len(words) - k + 1
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK_SHINGLES):
        bits = np.unpackbits(hashed[at: at + BLOCK_SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed 64-bit integer (a clashing column is replaced)."""
    kept, schema = common.extended(docs, [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.texts(batch)], dtype=np.uint64)
            yield common.appended(batch, {"fp": pa.array(fps.view(np.int64), pa.int64())})

    return kept.mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set (64 by 64, summed over tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            words = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(words, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(64 * 64 + 1), pa.int64()),
            pa.array(np.append(both.ravel(), n).astype(np.int64), pa.int64())], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(64 * 64 + 1)
    for c in cells:
        flat[c.cell] = c.n
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Cut the 64 bits into groups of like size, correlated bits together (greedy, from the most varying bit)."""
    p = np.diag(both) / max(n, 1)
    var = p * (1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var)))
    corr = np.nan_to_num(corr)
    free, out = list(np.argsort(-var, kind="stable")), []
    for g in range(groups):
        size = len(free) // (groups - g)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(int(b) for b in group))
    return out


def match_chance(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most t bits of the group, t = 0..most (bits taken one by one)."""
    p = np.diag(both)[group] / max(n, 1)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for d in 2 * p * (1 - p):
        chance = chance * (1 - d) + np.concatenate(([0], chance[:-1])) * d
    return np.cumsum(chance).tolist()


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of the least total cost with sum ``distance - m + 1``; ``costs[i][t + 1]`` is group i's at t."""
    m = len(costs)
    # used: the sum so far of t + 1, which is distance + 1 in the end
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for raised, more in enumerate(row):
                total = (cost + more, [*chosen, raised - 1])
                if used + raised <= distance + 1 and (used + raised not in step or total < step[used + raised]):
                    step[used + raised] = total
        best = step
    assert len(best[distance + 1][1]) == m
    return best[distance + 1]


def plan(n: int, both: np.ndarray, distance: int, most_groups: int = 6) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds with the fewest estimated probes and candidates."""
    options = []
    for m in range(1, max(2, min(most_groups, 2 * distance + 2)) + 1):
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            chance = match_chance(n, both, g, distance)
            probes = np.cumsum([comb(len(g), r) for r in range(distance + 1)])
            costs.append([0.0] + [float(n * probes[t] + n * n / 2 * chance[t]) for t in range(distance + 1)])
        options.append((*allocate(costs, distance), groups))
    _, thresholds, groups = min(options, key=lambda o: o[0])
    return groups, thresholds


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit integer."""
    word = sum(1 << b for b in bits)
    return word - (1 << 64) if word >> 63 else word


def balls(bits: list[int], radius: int) -> list[int]:
    """Masks of all sets of at most ``radius`` of the bits."""
    return [mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def flipped(fp: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m))


def filed_under(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(g, v, fp, home): every fingerprint under its value in each used group, and under those within the threshold."""

    def keys(i: int, bits: list[int], threshold: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(mask(bits)).cast("long"))
        return F.transform(flipped(own, balls(bits, threshold)), lambda v: F.struct(
            F.lit(i).alias("g"), v.alias("v"), (v == own).alias("home")))

    used = [keys(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    return nodes.select("fp", F.inline(F.concat(*used)))


def links(nodes: DataFrame, distance: int, groups: list[list[int]], thresholds: list[int], dense: int) -> DataFrame:
    """(a, b) with a > b: links that join exactly the fingerprints within ``distance``, directly or over a third one."""
    filed = filed_under(nodes, groups, thresholds)
    sizes = filed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("held")).where(
        (F.col("n") > 1) & F.col("held")).select("g", "v", (F.col("n") > dense).alias("crowded"))
    shared = materialize(filed.join(sizes, ["g", "v"]), "simhash-filed")
    thin = shared.where(~F.col("crowded"))
    left = thin.select("g", "v", F.col("fp").alias("a"), F.col("home").alias("ha"))
    right = thin.select("g", "v", F.col("fp").alias("b"), F.col("home").alias("hb"))
    pairs = left.join(right, ["g", "v"]).where(
        (F.col("a") > F.col("b")) & (F.col("ha") | F.col("hb"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    crowd = shared.where(F.col("crowded")).select("fp").distinct()
    return pairs.unionByName(over_midpoints(crowd, distance)).distinct()


def over_midpoints(nodes: DataFrame, distance: int) -> DataFrame:
    """Links among ``nodes`` over common words: exact for even distances; odd ones verify the last bit.

    Words within ``distance // 2`` bits of both ends exist for an even distance, and any two holders of such a
    word are within it. For an odd distance one end's ball is a bit wider, so a holder at the narrow radius
    meets those at the wide one; a word's holders are linked to its least narrow holder.
    """
    bits, half = list(range(64)), distance // 2
    narrow = nodes.select(F.explode(flipped(F.col("fp"), balls(bits, half))).alias("w"), "fp", F.lit(True).alias("near"))
    if distance % 2:
        outer = [m for m in balls(bits, half + 1) if bin(m & (1 << 64) - 1).count("1") == half + 1]
        narrow = narrow.unionByName(
            nodes.select(F.explode(flipped(F.col("fp"), outer)).alias("w"), "fp", F.lit(False).alias("near")))
    least = narrow.groupBy("w").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("root"), F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) & F.col("root").isNotNull())
    pairs = narrow.join(least, "w").where(F.col("fp") != F.col("root"))
    return pairs.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, dense: int = 64,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, its ``fp``, and the least doc_id of its component.

    ``dense`` only chooses between two exact ways of linking, by size of a group value.
    """
    columns = list(dict.fromkeys(["doc_id", *keep]))
    fps = materialize(with_fingerprint(docs.select("text", *columns), shingle).select("fp", *columns), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    n, both = bit_counts(nodes)
    groups, thresholds = plan(n, both, distance)
    roots = star_components(links(nodes.select("fp"), distance, groups, thresholds, dense))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    first = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return fps.join(labelled.select("fp", "root").join(first, "root"), "fp").select(*columns, "fp", "root", "component_id")
