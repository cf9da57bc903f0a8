"""SimHash fingerprints, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from tracefold.llm import components, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i: i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, distance):
    """{position: least position reachable}."""
    vals = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(vals)):
        for j in np.flatnonzero(np.bitwise_count(vals[i] ^ vals) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near_words(rng, centres, each, most):
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2):
        for _ in range(each):
            bits = rng.choice(64, rng.integers(0, most + 1), replace=False)
            out.append(int(c) ^ sum(1 << int(b) for b in bits))
    return list(dict.fromkeys(out))


def test_fingerprint_equals_the_rule(odd_texts):
    texts = [t for _, t in odd_texts] + ["A\x1cB c\x0bd", "one", "one two", "É é A a", "a b c a b c a b c"]
    for t in texts:
        assert simhash.fingerprint(t, 3) == plain_fingerprint(t)
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


@pytest.mark.parametrize("distance,groups,thresholds,dense", [
    (2, None, None, 64), (2, None, None, 1), (2, 2, [1, 0], 64), (2, 2, [0, 1], 2), (2, 4, [0, -1, 0, 0], 64),
    (2, 1, [2], 64), (3, 2, [1, 1], 64), (3, 4, [0, 0, 0, 0], 1), (1, None, None, 1), (0, None, None, 64)])
def test_links_lose_nothing(spark, distance, groups, thresholds, dense):
    rng = np.random.default_rng(distance * 7 + dense)
    fps = [0, *near_words(rng, 40, 6, 3), *near_words(rng, 2, 60, 2)]
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    n, both = simhash.bit_counts(nodes)
    assert n == len(fps) and both[5, 5] == sum(f >> 5 & 1 for f in fps)
    if groups is None:
        cut, thresholds = simhash.plan(n, both, distance)
    else:
        cut = simhash.group_bits(n, both, groups)
    assert sorted(b for g in cut for b in g) == list(range(64))
    assert sum(thresholds) == distance - len(cut) + 1
    got = {(r.a, r.b) for r in simhash.links(nodes, distance, cut, thresholds, dense).collect()}
    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= distance
    found = components.star_components(spark.createDataFrame(list(got) or [(0, 0)], "a long, b long"))
    root = {r.node: r.root for r in found.collect()}
    want = plain_components(fps, distance)
    groups_of = {}
    for f, w in zip(fps, want, strict=True):
        groups_of.setdefault(w, set()).add(root.get(signed(f), signed(f)))
    assert all(len(s) == 1 for s in groups_of.values())
    assert len({next(iter(s)) for s in groups_of.values()}) == len(groups_of)


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(3)
    from itertools import product
    for m in (1, 2, 3, 4):
        costs = [sorted(rng.random(4).tolist()) for _ in range(m)]
        cost, chosen = simhash.allocate(costs, 2)
        best = min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True))
                   for ts in product(range(-1, 3), repeat=m) if sum(ts) == 2 - m + 1)
        assert abs(cost - best) < 1e-12 and sum(chosen) == 2 - m + 1


def test_components_of_chains_hubs_and_loops(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components.star_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[k] == 1000 for k in range(1001, 1200))
    assert 5000 not in got
    assert components.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_result(pairs):
    fps = [plain_fingerprint(t) for _, t in pairs]
    comp = plain_components(fps, 2)
    least = {}
    for (d, _), c in zip(pairs, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(pairs, fps, comp, strict=True)), key=str)


def test_odd_rows(make_docs, odd_texts):
    from pyspark.sql import functions as F
    docs = make_docs(odd_texts).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == plain_result(odd_texts)
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(make_docs([(None, "a b c")])).collect()] == [None]


def test_op1_equals_brute_force(spark):
    from tracefold.llm.queries import QUERIES
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op1_simhash"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_result(pairs)
