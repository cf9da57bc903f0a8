"""Source divergence against plain Python with whole numbers, skybands against all pairs of rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tracefold.llm import divergence as D

SF = "/root/testdata/sf0.01"


def plain(rows, least, top):
    langs, groups, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang, source].update(words)
        langs[lang].update(words)
        docs[lang].update(set(words))
    out = set()
    kept = {lang: [t for t in c if docs[lang][t] >= least] for lang, c in langs.items()}

    def p(counts, lang):
        n = sum(counts[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 5) // n for t in kept[lang]}
    for lang, source in groups:
        own = p(groups[lang, source], lang)
        pairs = [(-sum(abs(own[t] - q[t]) for t in own), other.encode())
                 for other, q in ((s, p(groups[lg, s], lang)) for lg, s in groups if lg == lang and s != source)]
        all_ = p(langs[lang], lang)
        terms = [(all_[t] - own[t], t.encode()) for t in own if groups[lang, source][t] and own[t] > all_[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = df.collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term long")


ODD = [("en", "a", "The cat. THE dog2cat"), ("en", "b", "the the cat"), ("en", None, None), ("en", "", ""), (None, "a", "lone word"), ("", "a", "word"),
       ("de", "a", "École école Katze the"), ("de", "c", "école"), ("fr", "z", "123 !!"), ("en", "b", "cat " * 5000), ("en", "b", "x" * 20_000),
       ("ü", "é", "a"), ("ü", "z", "a b"), ("ü", "A", "b")]


@pytest.mark.parametrize("least", [1, 2, 50])
def test_odd_rows(spark, least):
    assert result(D.divergence(frame(spark, ODD), least, 3)) == plain(ODD, least, 3)


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in "uvwxyz"]
    return [(rnd.choice("xy"), rnd.choice(["s1", "s1", "s1", "s2", "s3", "s4"]),
             " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rnd.randint(0, 30)))) for _ in range(n)]


def test_small_slices_and_bands(spark, monkeypatch):
    rows = random_rows(3)
    for name, value in (("CELLS", 10), ("ENTRIES", 20), ("BAND_ROWS", 8)):
        monkeypatch.setattr(D, name, value)
    assert result(D.divergence(frame(spark, rows).repartition(7), 5, 4)) == plain(rows, 5, 4)


def test_empty_table(spark):
    assert D.divergence(frame(spark, [])).count() == 0


def test_skyband_keeps_those_with_few_dominators():
    rnd = random.Random(6)
    for k in (1, 3, 10):
        rows = [(rnd.randint(1, 8), rnd.randint(1, 8), f"t{i:03}".encode(), i) for i in rnd.sample(range(999), 150)]
        want = {b for b in rows if sum(a[0] >= b[0] and a[1] <= b[1] and a[2] < b[2] for a in rows) < k}
        assert set(D.band_of(rows, k)) == want


def test_shares_are_exact():
    rnd = random.Random(2)
    total = [rnd.randint(1, 10**15) for _ in range(300)]
    counts = [rnd.randint(0, t) for t in total]
    assert D.shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, total, strict=True)]


def test_op13_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = set(con.sql(ORACLE["op13_source_divergence"]).fetchall())
    assert result(QUERIES["op13_source_divergence"](spark, SF)) == want
