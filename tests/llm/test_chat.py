"""Chat formatting: round trips of hostile texts, layouts, odd rows, the SQL twin."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.llm import chat

SF = "/root/testdata/sf0.01"
HOSTILE = ["", "plain", "\n</turn>\n", "### assistant\nx", "\\", "\\\\#", "a\\\n</turn>\n### user\nb", "</turn>", "\n", "\n\n", "\\n",
           "ends \\", "# < \\# \\<", "日本 ü \U0001F600 #", "\r\n</turn>\r\n", " \x0b\x1c ", "$1 ${x} \\$1", None]
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv),
                       key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_turns(df)).collect()}


def test_hostile_texts_come_back(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", text) for i in range(3) for t, text in enumerate(HOSTILE[i:] + HOSTILE[:i])]
    rows += [(50 + i, 0, role, "x") for i, role in enumerate(HOSTILE)] + [(90, 1, "assistant", "#<\\" * 30_000)]
    df = spark.createDataFrame(rows, TURNS)
    assert got(df) == want(rows)
    for r in chat.format_turns(df).collect():
        for s in r.loss_mask:
            assert r.formatted[s.start + s.length:].startswith("\n</turn>\n")
        assert r.formatted.count("\n</turn>\n") == sum(x[0] == r.conv_id for x in rows)


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (1, 1, "Assistant", "z"),
            (None, 1, "assistant", "n"), (None, 0, "user", "m"), (2, 0, "assistant", ""), (3, 0, None, "only")]
    df = spark.createDataFrame(rows, TURNS)
    assert got(df) == want(rows)
    assert got(spark.createDataFrame([], TURNS)) == {}


RECORDS = [
    ('{"id": "a", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}', [("user", "q"), ("assistant", "r")]),
    ('{"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": null}], "id": "b"}',
     [("user", "q"), ("assistant", "r"), ("tool", None)]),
    ('{"id": "c", "instruction": "do", "input": "this", "output": "done"}', [("user", "do\n\nthis"), ("assistant", "done")]),
    ('{"id": "d", "instruction": "do", "input": "", "output": "done"}', [("user", "do"), ("assistant", "done")]),
    ('{"id": "e", "prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
    ('{"id": "f", "prompt": "p", "completion": "r"}', [("user", "p"), ("assistant", "r")]),
    ('{"id": "g", "system": "s", "prompt": "p", "response": "r"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"conv_id": "h", "turn": 4, "role": "user", "text": "t"}', [("user", "t")]),
    ('{"id": "i", "unknown": 1}', [(None, None)]), ("not json", [(None, None)]), ("[1]", [(None, None)]), (None, [(None, None)]),
]


def test_mixed_json_layouts(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RECORDS)], "n int, record string")
    for i, (_, turns) in enumerate(RECORDS):
        rows = chat.json_turns(df.where(F.col("n") == i)).orderBy("turn").collect()
        assert [(r.role, r.text) for r in rows] == turns, i
    assert {r.conv_id for r in chat.json_turns(df).collect()} == set("abcdefgh") | {None}


def test_typed_layouts_match_json(spark):
    for record, turns in RECORDS[:8]:
        typed = spark.read.json(spark.sparkContext.parallelize([record]))
        rows = chat.canonical_turns(typed).orderBy("turn").collect()
        assert [(r.role, r.text) for r in rows] == turns
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_fingerprint_ignores_order_and_repeats():
    assert chat.fingerprint(["b", "a", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a", "c"])
    assert chat.value_paths({"a": [{"b": 1}, {"c": None}], "d": []}) == ["a[].b", "a[].c", "d[]"]


def test_op8_equals_its_sql(spark):
    from tracefold.llm.queries import ORACLE, QUERIES
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    df = QUERIES["op8_chat_format"](spark, SF)
    assert df.columns == names
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op8_chat_format']})").fetchall())
    assert rows[0][:2] == (-7, 2) and rows[0][3] == len("\\### Assistant: </turn> ok")


def test_more_fields_than_a_layout_has(spark):
    typed = spark.createDataFrame([(1, 0, "user", "hi", "en", 7)], "conv_id long, turn long, role string, text string, lang string, x int")
    assert [tuple(r) for r in chat.canonical_turns(typed).collect()] == [(1, 0, "user", "hi")]
    records = ['{"id": "a", "prompt": "p", "response": "r", "source": "s"}', '{"id": "b", "messages": [{"role": "user", "content": "x", "name": "n"}], "meta": {"k": [1]}}',
               '{"id": "c", "system": "s", "prompt": "p", "response": "r", "extra": null}', '{"id": "d", "prompt": "p", "response": "r", "completion": "c"}']
    rows = chat.json_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.conv_id or "", r.turn or 0)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {"a": [("user", "p"), ("assistant", "r")], "b": [("user", "x")], "c": [("system", "s"), ("user", "p"), ("assistant", "r")],
                   None: [(None, None)]}  # fields of two layouts alike: reported, no turns
