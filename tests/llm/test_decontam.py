"""Decontamination against a plain window search."""

import re

import duckdb

from tracefold.llm import decontam

SF = "/root/testdata/sf0.01"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_judge(text, items, size=13):
    words = plain_words(text)
    hit, found = set(), []
    for item, body in items:
        w = plain_words(body)
        k = min(size, len(w))
        wins = {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if w else set()
        at = [i for i in range(len(words) - k + 1) if wins and tuple(words[i: i + k]) in wins]
        hit.update(j for i in at for j in range(i, i + k))
        found += [str(item)] * bool(at)
    n, h = len(words), len(hit)
    return n, h, len(found), decontam.digest(found), h > 0 and 20 * h >= n


LONG = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ITEMS = [(1, LONG), (2, "Short Item"), (3, None), (4, "... !"), (10, "short item"), (5, "école à 9"), (6, "one two one two"), (7, "x")]
DOCS = [
    (1, None), (2, ""), (3, "!!"), (4, f"pre {LONG.upper()}, post"), (5, "a short\nitem b shortitem short items"),
    (6, "one two one two one two three"), (7, "École à 9. ecole"), (8, "x " * 3), (9, LONG[5:]), (10, "w " * 5000 + "short item"),
    (None, "short-item"), (4, "x"), (11, LONG.replace("six", "6")), (12, "ünshort item")]


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_rule_on_odd_rows_in_one_and_many_blocks(spark, make_docs):
    from pyspark.sql import functions as F
    docs = make_docs(DOCS).withColumn("n_hit", F.lit("clash")).withColumn("Spans", F.lit(1)).withColumn("items", F.lit(2))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("lang", F.lit("en"))
    want = sorted(((d, *plain_judge(t, ITEMS)) for d, t in DOCS), key=str)
    for block in (1 << 20, 30, 1):
        out = decontam.judged(docs, bench, block_bytes=block)
        assert [c for c in out.columns if c in ("lang", "source", "n_chars")] == ["lang", "source", "n_chars"]
        assert rows(out) == want


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judged(make_docs([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert rows(decontam.judged(make_docs(DOCS[:5]), none)) == sorted(((d, *plain_judge(t, [])) for d, t in DOCS[:5]), key=str)


def test_offsets_map_to_the_original():
    text = "Say: ÉCOLE, À 9! then Short  Item."
    items = tuple((str(i), t or "") for i, t in ITEMS)
    n, spans, _ = decontam.scan(text, items, 13)
    assert [text[a:b] for a, b in decontam.char_spans(text, spans)] == ["Short  Item"]
    assert n == 7
    n, spans, _ = decontam.scan("École... À", (("1", "École à"),), 13)
    assert spans == []  # É is not lower-cased: only A-Z are
    _, spans, _ = decontam.scan("(école) à!", (("1", "École à"), ("2", "école À")), 13)
    assert spans == []
    _, spans, _ = decontam.scan("(école) À!", (("2", "école À"),), 13)
    assert decontam.char_spans("(école) À!", spans) == [(1, 9)]


def test_repeated_items_count_once_and_characters_are_given(spark, make_docs):
    items = [(1, "short item"), (1, "short item"), (1, "another item"), (2, "short item"), (None, "short item")]
    docs = make_docs([(1, "Say: a Short  Item, and another ITEM!"), (2, "none"), (3, None), (4, "Ünï short\titem. short item")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 1):
        got = {r.doc_id: r for r in decontam.find_items(docs, bench, block_bytes=block).collect()}
        assert got[1]["items"] == ["", "1", "2"] and got[2]["items"] == got[3]["items"] == []
        said = {d: [got[d].text[c.begin: c.end] for c in got[d].chars] for d in (1, 4)}
        assert said == {1: ["Short  Item", "another ITEM"], 4: ["short\titem. short item"]}
        assert decontam.judged(docs, bench, block_bytes=block).where("doc_id = 1").first().n_items == 3


def test_many_items_are_read_once_a_task(make_docs, spark):
    import time
    items = spark.range(50_000).selectExpr("id AS item_id", "concat('item number ', id, ' of many') AS text")
    docs = make_docs([(i, f"text {i} with item number {i * 7} of many words") for i in range(2000)]).coalesce(2)
    start = time.time()
    rows_ = decontam.find_items(docs, items, block_bytes=1 << 30).collect()
    assert time.time() - start < 60 and all(r["items"] == ([str(r.doc_id * 7)] if r.doc_id * 7 < 50_000 else []) for r in rows_)


def test_op7_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    got = rows(QUERIES["op7_decontamination"](spark, SF))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op7_decontamination']})").fetchall(), key=str)
    assert got == want
    assert 0 < sum(r[5] for r in got) < len(got)
