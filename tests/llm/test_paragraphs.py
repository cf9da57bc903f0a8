"""Paragraph sketches: peeling recovers exactly the differing digests; fingerprints, edits and order against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracefold.llm import paragraphs as P

SF = "/root/testdata/sf0.001"


def test_peeling_recovers_the_differences(spark):
    rnd = random.Random(3)
    pairs = []
    for k, (common, mine, theirs) in enumerate([(0, 0, 0), (5, 0, 0), (0, 1, 0), (0, 0, 3), (40, 3, 4), (300, 5, 0), (0, 200, 150), (30, 90, 90),
                                                (1000, 700, 900), (9, 8000, 100), *[(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(200)]]):
        v = rnd.sample(range(-2**61, 2**61), common + mine + theirs)
        pairs.append((k, v[:common + mine], v[:common] + v[common + mine:]))
    got = {r.pair: r for r in P.differences(spark.createDataFrame(pairs, "pair long, a array<long>, b array<long>")).collect()}
    assert len(got) == len(pairs)
    for k, a, b in pairs:
        assert sorted(got[k].mine) == sorted(set(a) - set(b)) and sorted(got[k].theirs) == sorted(set(b) - set(a))


def test_what_does_not_peel_is_sketched_again(spark, monkeypatch):
    # sketches far too small at first: nearly all get stuck and are retried, larger each time
    monkeypatch.setattr(P, "width_for", lambda units: F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.greatest(units / 8, F.lit(2)))).cast("int")))
    rnd = random.Random(4)
    pairs = [(k, rnd.sample(range(10**9), 60), rnd.sample(range(10**9), 60)) for k in range(30)]
    got = {r.pair: r for r in P.differences(spark.createDataFrame(pairs, "pair long, a array<long>, b array<long>")).collect()}
    assert all(sorted(got[k].mine) == sorted(set(a) - set(b)) and sorted(got[k].theirs) == sorted(set(b) - set(a)) for k, a, b in pairs)


def test_likeness_of_stuck_pairs_is_exact_too(spark, make_docs, monkeypatch):
    texts = [(i, "\n".join(f"line {i * 3 + k}" for k in range(60))) for i in range(40)]
    want = {r.doc_id: r for r in P.edited_likeness(make_docs(texts)).collect()}
    monkeypatch.setattr(P, "PASSES", 1)
    first = P.sketched(make_docs(texts)).where("stuck_edited OR stuck_next").count()
    got = {r.doc_id: r for r in P.edited_likeness(make_docs(texts)).collect()} if first else {}
    assert first > 5 and got == want


def plain_units(spark, texts):
    """{text: set of digests}, by the operator's own cutting."""
    rows = spark.createDataFrame([(t,) for t in set(texts)], "text string").select("text", P.digests(F.col("text")).alias("d")).collect()
    return {r.text: set(r.d) for r in rows}


def test_op9_likeness_equals_brute_force(spark, result):
    pairs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ordered = sorted(pairs, key=lambda p: -p[0])
    follows = {d: ordered[(k + 1) % len(ordered)][1] for k, (d, _) in enumerate(ordered)}
    texts, edits = dict(pairs), {d: t for d, _, t in plain_edits(pairs)}
    units = plain_units(spark, [*texts.values(), *edits.values()])

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    for r in result:
        own = units[texts[r.doc_id]]
        assert r.near_edited == like(own, units[edits[r.doc_id]])
        assert r.near_next == like(own, units[follows[r.doc_id]])


def test_fingerprints_are_sums_of_cells(spark, result):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    units = plain_units(spark, texts.values())
    for r in result:
        cells = [r.fingerprint[36 * i: 36 * i + 36] for i in range(P.ROWS * P.WIDTH)]
        assert len(r.fingerprint) == 36 * len(cells)
        for row in range(P.ROWS):  # every digest is in one cell of each row
            part, xor = cells[P.WIDTH * row: P.WIDTH * (row + 1)], 0
            for d in units[texts[r.doc_id]]:
                xor ^= d & (2**64 - 1)
            assert sum(int(c[:4], 16) for c in part) == len(units[texts[r.doc_id]])
            total = 0
            for c in part:
                total ^= int(c[4:20], 16)
            assert total == xor


def test_a_long_text_takes_time_in_proportion(make_docs):
    import time
    texts = [(1, " ".join(f"word{i}" for i in range(50_000))), (2, "short")]
    start = time.time()
    rows = {r.doc_id: r for r in P.edited_likeness(make_docs(texts)).collect()}
    assert time.time() - start < 60 and 0.4 < rows[1].near_edited < 0.8


def plain_edits(pairs):
    """{position in descending order: (doc_id, edited text)}."""
    ordered = sorted(pairs, key=lambda p: (-(p[0] if p[0] is not None else -2**63), (p[1] or "").encode()))
    out = []
    for k, (doc, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        out.append((doc, len(text), text[: len(text) - third] + following[:third]))
    return out


@pytest.fixture(scope="module")
def result(spark):
    from tracefold.llm.queries import QUERIES
    return QUERIES["op9_paragraph_sketch"](spark, SF).collect()


def test_op9_edits_equal_brute_force(spark, result):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in plain_edits(pairs)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in result} == want


def test_op9_tells_edits_from_neighbours(spark, result):
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in result)
    assert sum(r.near_edited > r.near_next for r in result) / len(result) > 0.97
    by_text = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        by_text.setdefault(r.text, set()).add(r.doc_id)
    prints = {r.doc_id: r.fingerprint for r in result}
    for ids in by_text.values():
        assert len({prints[i] for i in ids}) == 1
    assert len(set(prints.values())) == len(by_text)


def test_edited_texts_share_units_at_any_length(make_docs):
    words = [f"word{i}" for i in range(400)]
    texts = ["".join(words)[:n] for n in (3, 4, 7, 40, 399, 400, 401, 1201, 3000, 9000)]  # no blanks
    texts += [" ".join(words)[:n] for n in (9, 399, 659, 1199, 1201, 2999)]  # one sentence
    texts += ["x" + " ".join(words)[:900] + ". " + "Short. " * 40, " ".join(words)[:1000] + "\n" + "line\n" * 60]  # a long head
    rows = P.edited_likeness(make_docs([*enumerate(texts), (-1, "0" * 9000)])).collect()
    assert len(rows) == len(texts) + 1
    assert {r.doc_id: r.near_edited for r in rows if r.near_edited == 0} == {}


def test_units_of_a_text(spark):
    def count(text):
        return spark.createDataFrame([(text,)], "text string").select(F.size(P.digests(F.col("text"))).alias("n")).first().n
    assert count("ab\ncd\nef\ngh\nij") == 5  # lines alone
    assert count("One two. Three four five. Six. Seven. Eight.") == 1 + 5 + 3  # the line, its sentences, words of the second
    assert count(" \n") == 0


def test_no_python_in_the_plan(spark):
    text = P.edited_likeness(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_odd_rows(make_docs, odd_texts):
    docs = make_docs([*odd_texts, (None, "also no id"), (20, "a b c"), (19, "a b c")]).withColumn("cells", F.lit("clash"))
    rows = P.edited_likeness(docs).collect()
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in plain_edits(pairs)), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == want
    twins = {r.doc_id: r for r in rows if r.doc_id in (19, 20)}
    assert twins[19].fingerprint == twins[20].fingerprint and twins[20].near_next == 1.0


def test_one_row_and_none(make_docs):
    (r,) = P.edited_likeness(make_docs([(1, "abc def ghi")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
    (r,) = P.edited_likeness(make_docs([(1, None)])).collect()
    assert (r.n_chars, r.near_edited, r.near_next) == (0, 1.0, 1.0)
    assert P.edited_likeness(make_docs([])).count() == 0
