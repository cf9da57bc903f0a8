"""The filter audit against plain Python over all orders, and its tries against sorted lists."""

import random
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.llm import filter_audit as A
from tracefold.llm import radix

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé\n", max_size=6), max_size=40))
def test_trie_holds_texts_in_order(texts):
    trie = radix.Trie()
    for t in texts:
        node = trie.node(t.encode())
        node.record = (node.record or 0) + 1
    found = list(trie.walk())
    assert [(t, n) for t, n, _ in found] == sorted((t.encode(), texts.count(t)) for t in set(texts))
    for (before, _, _), (text, _, key) in zip(found, found[1:], strict=False):
        assert text.startswith(key) and before < key and not before.startswith(key)
        assert key[:-1] <= before or before.startswith(key[:-1])  # no shorter prefix does


def test_cuts_share_the_weight():
    rnd = random.Random(1)
    keys = [(bytes([rnd.randrange(256), rnd.randrange(256)]), rnd.randint(1, 9)) for _ in range(1000)]
    cuts = [k for k, _ in radix.weighted_cuts(keys, 10)]
    assert len(cuts) == 10 and cuts == sorted(cuts)
    for a, b in zip([b"", *cuts], cuts, strict=False):
        assert abs(sum(w for k, w in keys if a < k <= b) - sum(w for _, w in keys) / 10) < 40
    assert radix.weighted_cuts([], 4) == []


def plain_mask(row, rows):
    text = row[1] or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    smaller = any((t or "") == text and d is not None and row[0] is not None and d < row[0] for d, t, _ in rows)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text), smaller]


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    fails = [(r, plain_mask(r, rows)) for r in rows]
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in fails if (r[2] or "") == part]
        total = [0] * 5
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step + 1] = [
                    len(left), len(gone), sum(m[f] for _, m in own) - len(gone), sum(m[f] and sum(m) == 1 for _, m in own),
                    sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total["ABCDE".index(key[1][key[2] - 1])])
    return out


def result(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [
    (5, None, "a"), (3, "", "a"), (9, " \n ", None), (7, LONG, "a"), (7, LONG, "b"), (2, LONG, "b"), (None, LONG, "b"), (8, LONG, ""),
    (1 << 60, LONG + " X", "a"), (-(1 << 62), LONG + " X", "a"), (10, "w " * 300, "b"), (11, "w " * 300, "b"), (12, LONG.upper(), "b"),
    (13, LONG + " #", "a"), (14, "x" * 50_000, "a"), (15, "nb sp\x85x " * 250, "a"), (16, "É" * 40 + "A", "a"), (16, "other", "a")]
LABELLED = [(5, 1, 0), (3, 0, 1), (7, 1, None), (7, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, 1), (11, 1, 1)]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_audit_of_odd_rows(spark, held):
    docs = spark.createDataFrame([(d, t, s, "x", 1) for d, t, s in ROWS], "doc_id long, text string, source string, part string, mask int")
    labels = spark.createDataFrame(LABELLED, LABELS).withColumn("good", F.lit(5))
    for parts in (1, 5):
        masks = A.document_masks(docs.repartition(parts), held)
        assert result(A.interactions(A.mask_counts(masks, labels))) == plain_audit(ROWS, LABELLED)


def test_masks_of_many_copies(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot text " * 30, "hot text " * 30 + str(rnd.randrange(40)), str(rnd.randrange(300))]), "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16)
    least = {}
    for d, t, _ in rows:
        least[t] = min(d, least.get(t, d))
    got = {r.doc_id: r.mask & A.DUPLICATE > 0 for r in A.document_masks(docs, 2000).collect()}
    assert got == {d: d != least[t] for d, t, _ in rows}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert result(A.audit(one, labels)) == plain_audit([(1, "a", "s")], [])


def test_op11_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = {r[:3]: list(r[3:]) for r in con.sql(ORACLE["op11_filter_audit"]).fetchall()}
    assert result(QUERIES["op11_filter_audit"](spark, SF)) == want
