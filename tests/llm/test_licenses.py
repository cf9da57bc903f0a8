"""License scans against a plain window search, and against their SQL twin."""

import math
import random
import re

import duckdb

from tracefold.llm import licenses as L

SF = "/root/testdata/sf0.01"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_scan(text, phrases, notices, threshold):
    words = plain_words(text)
    places, base, best, found = [], set(), 0.0, set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i: i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for start in range(0, len(words), L.STRIDE):
        block = set(words[start: start + L.BLOCK])
        for label, notice in notices:
            want = set(plain_words(notice))
            if want and len(block & want) >= math.ceil(round(threshold * len(want), 9)):
                found.add(label)
                best = max(best, len(block & want) / len(want))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if base else best)


def rows(df):
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


MIT = L.TEMPLATES[8][1]
FILL = " ".join(f"f{i}" for i in range(200))
TEXTS = [
    (1, None), (2, ""), (3, " .,"), (4, "Under the MIT License"), (5, "under the mit\tlicense, under the MIT-license! undertthe mit license"),
    (6, f"{FILL} {MIT} {FILL}"), (7, f"{FILL} {MIT.replace('granted', '').replace('Software', 'work')}"), (8, MIT.replace("free", "").replace("any", "").replace("copy", "").replace("deal", "")),
    (9, "CC BY-NC; cc by nc 4.0 apache license version 2.0"), (10, "Licensed under the Apache License, Version 2.0."),
    (11, "This work is licensed under the GNU General Public License, version 2"), (12, "Released under the License mit " * 300),
    (13, "released " + FILL + " under the mit license"), (None, "cc by nc"), (4, "Under the MIT License"),
    (14, "under the mİt license, worK under the mit lİcense"), (15, "x" * 50_000 + " cc by nc"), (16, "under the mit élicense"),
    (1 << 60, "word " * 20_000 + "under the mit license")]


def test_scan_of_odd_rows(make_docs):
    docs = make_docs(TEXTS).withColumnRenamed("source", "row").withColumnRenamed("lang", "words")
    for notices, threshold in ((L.TEMPLATES, 0.9), (L.TEMPLATES, 0.8), ([("a", "w1 w2"), ("a", "..."), ("b", "the the")], 1.0)):
        got = rows(L.scan(docs, L.PHRASES, notices, threshold))
        assert got == sorted(((d, *plain_scan(t, L.PHRASES, notices, threshold)) for d, t in TEXTS), key=str)
    assert L.scan(make_docs([])).count() == 0


def test_join_finds_every_block(make_docs):
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(30)]
    notices = [(f"n{k}", " ".join(rnd.sample(vocabulary, rnd.randint(1, 20)))) for k in range(25)]
    texts = [(i, " ".join(rnd.choices([*vocabulary, "o1", "o2"], k=rnd.choice([3, 30, 70, 200])))) for i in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        got = rows(L.scan(make_docs(texts), {"v1 v2": "p"}, notices, threshold))
        assert got == sorted(((d, *plain_scan(t, {"v1 v2": "p"}, notices, threshold)) for d, t in texts), key=str)


def test_pairs_come_once(spark):
    sets = L.notice_sets([("a", "x y z"), ("b", "y z")], 0.5)
    blocks = spark.createDataFrame([(1, [(0, ["x", "y", "z"]), (1, ["z"])])], "row long, blocks array<struct<block: int, words: array<string>>>")
    got = sorted((r.block, r.label, r.share) for r in L.similar_blocks(blocks, sets, ["x", "y", "z"]).collect())
    assert got == [(0, "a", 1.0), (0, "b", 1.0), (1, "b", 0.5)]


def test_no_python_in_the_plan(spark):
    text = L.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_op12_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(ORACLE["op12_license_scan"]).fetchall(), key=str)
    got = rows(QUERIES["op12_license_scan"](spark, SF))
    assert got == want and sum(r[2] > 0 for r in got) > 3 and sum(r[6] != r[5] for r in got) > 3
