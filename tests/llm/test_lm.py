"""Stupid backoff against a plain count, and its SQL twin."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracefold.llm import lm

SF = "/root/testdata/sf0.01"


def plain_scores(texts, order):
    docs = [(t or "").encode().lower().split() for t in texts]
    grams = [Counter(tuple(d[i: i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1)) for d in docs]
    total, words = sum(grams, Counter()), sum(map(len, docs))
    out = []
    for d, own in zip(docs, grams, strict=True):
        others, score = words - len(d), 0.0
        for i in range(len(d)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                g = tuple(d[i - k + 1: i + 1])
                if total[g] - own[g] > 0:
                    context = total[g[:-1]] - own[g[:-1]] if k > 1 else others
                    score += (most - k) * math.log(lm.ALPHA) + math.log((total[g] - own[g]) / context)
                    break
            else:
                score += most * math.log(lm.ALPHA) - math.log(others + 1)
        out.append((len(d), round(score, 6)))
    return out


@pytest.mark.parametrize("order,block", [(1, 10), (2, 1), (2, 10**6), (3, 40), (5, 7)])
def test_scores_equal_a_plain_count(make_docs, odd_texts, order, block):
    from pyspark.sql import functions as F
    texts = [*odd_texts, (40, "a b a b a b c"), (41, "a b c a"), (42, "A B"), (43, "zz"), (44, "b c a b"), (44, "b c a b")]
    docs = make_docs(texts).withColumn("block", F.lit("clash")).withColumn("n_words", F.lit(3))
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm.stupid_backoff(docs, order, block).collect()), key=str)
    assert got == sorted(((i, *s) for (i, _), s in zip(texts, plain_scores([t for _, t in texts], order), strict=True)), key=str)


def test_no_rows_and_no_words(make_docs):
    assert lm.stupid_backoff(make_docs([])).count() == 0
    assert [tuple(r) for r in lm.stupid_backoff(make_docs([(1, None), (2, " ")])).orderBy("doc_id").collect()] == [
        (1, 0, 0.0, None), (2, 0, 0.0, None)]
    (r,) = lm.stupid_backoff(make_docs([(1, "x y")])).collect()
    assert np.isclose(r.log_score, 3 * math.log(lm.ALPHA))


def test_packing_of_integers():
    for v in (np.array([], np.uint64), np.array([0, 5, 2**64 - 1], np.uint64), np.arange(1000, dtype=np.uint64) ** 3):
        assert lm.unpacked(lm.packed(v)).tolist() == v.tolist()
        assert lm._unwide(lm._wide(v)).tolist() == v.tolist()
    assert lm.unplain(lm.plain(np.array([3, 1, 2**32 - 1]))).tolist() == [3, 1, 2**32 - 1]


def test_op4_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    names = ["doc_id", "n_words", "log_score", "mean_log_score"]
    got = sorted(map(tuple, QUERIES["op4_lm_score"](spark, SF).select(*names).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op4_lm_score']})").fetchall())


def test_blocks_are_not_shuffled(make_docs):
    plan = lm.stupid_backoff(make_docs([(i, "a b c d") for i in range(20)]), 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1  # the counts that come back


def test_spans_hold_whole_documents():
    docs = np.repeat(np.arange(6), [3, 1, 9, 0, 2, 4])
    for size in (1, 4, 100):
        cuts = list(lm.spans(docs, size))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(docs)))
        assert all(docs[a - 1] != docs[a] for a, _ in cuts[1:])
    assert not list(lm.spans(docs[:0]))
