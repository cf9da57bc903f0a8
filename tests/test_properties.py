
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracefold.operators import runs as RU
from tracefold.operators.sequence import running_index, running_sum
from tracefold.sources import derive


msg_lists = st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, None, "a", "b", "z"])),
                     min_size=1, max_size=12)


@settings(max_examples=20, deadline=None)
@given(msg_lists)
def test_w6_order_invariants(spark, raw):
    """Nothing is lost; other messages keep their order; returns follow the first holder of their call or come last."""
    msgs = [(i, call if ret is None else None, ret) for i, (call, ret) in enumerate(raw)]
    df = spark.createDataFrame([("r", p, "x", c, r) for p, c, r in msgs],
                               "run_id string, pos long, role string, call_id string, return_id string")
    got = [r.pos for r in sorted(RU.order_tool_returns(df, bucket_width=2).collect(), key=lambda r: r.new_pos)]
    assert sorted(got) == list(range(len(msgs)))
    plain = [p for p in got if msgs[p][2] is None]
    assert plain == sorted(plain)
    place = {p: k for k, p in enumerate(got)}
    holder = {}
    for p, call, _ in msgs:
        if call is not None:
            holder.setdefault(call, p)
    for p, _, ret in msgs:
        if ret is not None:
            between = got[place[holder[ret]] + 1: place[p]] if ret in holder else got[place[p]:]
            assert all(msgs[q][2] is not None for q in between)  # only returns stand between, or behind an orphan
    same = {}
    for p in got:
        same.setdefault(msgs[p][2], []).append(p)
    assert all(v == sorted(v) for k, v in same.items() if k is not None)
    # idempotent: messages already in the new order stay where they are
    by_pos = {p: (c, r) for p, c, r in msgs}
    again = spark.createDataFrame([("r", i, "x", by_pos[p][0], by_pos[p][1]) for i, p in enumerate(got)],
                                  "run_id string, pos long, role string, call_id string, return_id string")
    assert sorted((r.pos, r.new_pos) for r in RU.order_tool_returns(again, bucket_width=3).collect()) == \
        [(i, i) for i in range(len(msgs))]


def test_running_index_exact_under_skew(spark):
    # one run holds a third of all rows, spread over many buckets
    rng = random.Random(7)
    rows = [("hot", s) for s in rng.sample(range(10_000_000), 3000)] + \
           [(f"r{i % 400}", rng.randrange(10_000_000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "run_id string, seq long").dropDuplicates(["run_id", "seq"])
    got = running_index(df, ["run_id"], ["seq"], F.floor(F.col("seq") / 50_000), "i")
    want = df.withColumn("j", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1)
    diff = got.join(want, ["run_id", "seq"]).where("i != j").count()
    assert diff == 0 and got.count() == df.count()


def test_running_sum_exclusive(spark):
    df = spark.createDataFrame([("k", i, i % 3) for i in range(50)], "k string, seq long, v long")
    got = running_sum(df, ["k"], ["seq"], F.col("v"), F.floor(F.col("seq") / 7), "s", inclusive=False)
    rows = sorted(got.collect(), key=lambda r: r.seq)
    acc = 0
    for r in rows:
        assert r.s == acc
        acc += r.v


def test_w1_last_running_value_is_the_whole_part(spark):
    c = derive.chunks(spark, SF_SMALL)
    run = RU.accumulate_text(c, "content")
    last = run.groupBy("run_id", "part_index", "segment").agg(F.max_by("content", "seq").alias("last"))
    final = RU.accumulate_text(c, "content", final_only=True)
    bad = last.join(final, ["run_id", "part_index", "segment"]).where("last != content").count()
    assert bad == 0 and final.count() == last.count() > 0


def test_w1_whole_text_is_reassembled(spark):
    # the word deltas of a part rebuild the original message text exactly
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'assistant'")
    final = RU.accumulate_text(derive.chunks(spark, SF_SMALL), "content", final_only=True)
    texts = conv.select(derive.run_id_of(F.col("conv_id")).alias("run_id"), "turn", "text")
    seg = final.withColumn("turn", F.floor(F.col("last_seq") / derive.TURN_STRIDE))
    assert seg.join(texts, ["run_id", "turn"]).where("content != text").count() == 0


def test_j2_pending_plus_resolved_is_requested(spark):
    c = derive.chunks(spark, SF_SMALL)
    d = derive.approvals(spark, SF_SMALL)
    requested = c.where("type = 'approval-requested'").select("run_id", "tool_call_id").distinct()
    pending = RU.pending_approvals(c, d).select("run_id", "tool_call_id")
    resolved = requested.join(pending, ["run_id", "tool_call_id"], "left_anti")
    assert pending.unionByName(resolved).distinct().count() == requested.count()
    assert pending.join(resolved, ["run_id", "tool_call_id"]).count() == 0


def test_lag_in_order_matches_window_lag(spark):
    from tracefold.operators.sequence import lag_in_order
    rng = random.Random(11)
    rows = [("hot", s, rng.randrange(1000)) for s in rng.sample(range(1_000_000), 2000)] + \
           [(f"r{i % 50}", rng.randrange(1_000_000), rng.randrange(1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, seq long, v long").dropDuplicates(["k", "seq"])
    got = lag_in_order(df, ["k"], "seq", F.floor(F.col("seq") / 20_000), ["v", "seq"])
    want = df.select("k", "seq", F.lag("v").over(Window.partitionBy("k").orderBy("seq")).alias("w"),
                     F.lag("seq").over(Window.partitionBy("k").orderBy("seq")).alias("ws"))
    j = got.join(want, ["k", "seq"])
    assert j.count() == df.count()
    assert j.where("NOT (prev_v <=> w) OR NOT (prev_seq <=> ws)").count() == 0


@pytest.mark.parametrize("width", [1, 3, 7])
def test_w10_same_for_any_slicing(spark, width):
    upd = derive.run_updates(spark, SF_SMALL)
    cols = ["run_id", "messages", "pending", "model", "created_at", "updated_at", "n_writes"]
    one = sorted(map(tuple, RU.fold_run_state(upd, bucket_width=1 << 30).select(*cols).collect()))
    many = sorted(map(tuple, RU.fold_run_state(upd, bucket_width=width).select(*cols).collect()))
    assert one == many and len(one) > 0


def brute_accumulate(events, kind):
    """Per-part accumulators, reset by a start; an empty start emits nothing; thinking skips empty deltas."""
    acc, out = {}, []
    for seq, k, part, is_start, delta in events:
        if k != kind:
            continue
        if is_start:
            acc[part] = delta
            if delta:
                out.append((seq, delta))
        else:
            if kind == "thinking" and not delta:
                continue
            acc[part] = acc.get(part, "") + delta
            out.append((seq, acc[part]))
    return out


event_lists = st.lists(st.tuples(st.sampled_from(["content", "thinking"]), st.sampled_from([0, 1]), st.booleans(),
                                 st.sampled_from(["", "a", "bc", " d"])), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None)
@given(event_lists)
def test_w1_w2_match_brute_force(spark, raw):
    from tracefold.schemas import CHUNKS
    events = [(i * 7, k, p, s, d) for i, (k, p, s, d) in enumerate(raw)]
    rows = []
    for seq, k, p, s, d in events:
        r = {f.name: None for f in CHUNKS.fields}
        r.update(run_id="r", seq=seq, type=k, part_index=p, is_start=s, delta=d)
        rows.append(tuple(r[f.name] for f in CHUNKS.fields))
    chunks = spark.createDataFrame(rows, CHUNKS)
    for kind in ("content", "thinking"):
        got = sorted((r.seq, r.content) for r in RU.accumulate_text(chunks, kind, bucket_width=20).collect())
        assert got == brute_accumulate(events, kind)


def brute_run_store(writes):
    """The run store's own semantics: upsert (model kept unless given), set_messages / set_pending, clear deletes."""
    state = None
    for seq, kind, messages, pending, model, at in sorted(writes):
        if kind == "clear":
            state = None
            continue
        if state is None:
            state = {"messages": None, "pending": None, "model": model, "created_at": at, "n": 0}
        elif model is not None:
            state["model"] = model
        if kind == "set_messages":
            state["messages"] = messages
        else:
            state["pending"] = pending
        state["updated_at"] = at
        state["n"] += 1
    return state


write_lists = st.lists(st.tuples(st.sampled_from(["set_messages", "set_pending", "set_pending", "clear"]),
                                 st.sampled_from([None, "m1", "m2"]), st.sampled_from([None, "p"])),
                       min_size=1, max_size=15)


@settings(max_examples=25, deadline=None)
@given(write_lists)
def test_w10_matches_run_store(spark, raw):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    writes = [(i, k, f"h{i}" if k == "set_messages" else None, p if k == "set_pending" else None,
               m if k != "clear" else None, t0 + dt.timedelta(seconds=i)) for i, (k, m, p) in enumerate(raw)]
    df = spark.createDataFrame([("r", *w) for w in writes],
                               "run_id string, seq long, kind string, messages string, pending string, model string, "
                               "written_at timestamp")
    want = brute_run_store(writes)
    got = RU.fold_run_state(df, bucket_width=4).collect()
    if want is None:
        assert got == []
    else:
        g = got[0]
        assert (g.messages, g.pending, g.model, g.created_at, g.updated_at, g.n_writes) == \
            (want["messages"], want["pending"], want["model"], want["created_at"], want["updated_at"], want["n"])


approval_events = st.lists(st.tuples(st.sampled_from(["approval-requested", "tool_result", "decision"]),
                                     st.sampled_from(["c1", "c2", "c3"])), min_size=1, max_size=20)


@settings(max_examples=25, deadline=None)
@given(approval_events)
def test_j2_matches_client_state(spark, raw):
    from tracefold.schemas import CHUNKS
    pending = {}
    for i, (ev, cid) in enumerate(raw):  # the client's reducer: a request adds or replaces, a result or decision removes
        if ev == "approval-requested":
            pending[cid] = i
        else:
            pending.pop(cid, None)
    chunk_rows, dec_rows = [], []
    for i, (ev, cid) in enumerate(raw):
        if ev == "decision":
            dec_rows.append(("r", cid, i, "true"))
            continue
        r = {f.name: None for f in CHUNKS.fields}
        r.update(run_id="r", seq=i, type=ev, tool_call_id=cid, tool_name="execute_sql")
        chunk_rows.append(tuple(r[f.name] for f in CHUNKS.fields))
    chunks = spark.createDataFrame(chunk_rows, CHUNKS)
    dec = spark.createDataFrame(dec_rows, "run_id string, tool_call_id string, seq long, value string")
    got = {r.tool_call_id: r.seq for r in RU.pending_approvals(chunks, dec).collect()}
    assert got == pending


# statement -> (capped text, first forbidden keyword)
STATEMENT_CASES = {
    "SELECT * FROM t": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t ;; ": ("SELECT * FROM t  LIMIT 1000", None),
    "SELECT * FROM t; ;": ("SELECT * FROM t;  LIMIT 1000", None),
    "SELECT * FROM t\n": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t -- note": ("SELECT * FROM t -- note LIMIT 1000", None),
    "SELECT * FROM t limit 5000": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t LIMIT  20000": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t LIMIT 1000": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t LIMIT 1001;": ("SELECT * FROM t LIMIT 1000;", None),
    "SELECT * FROM t\tLIMIT\t9": ("SELECT * FROM t\tLIMIT\t9", None),
    "SELECT * FROM t LIMIT ALL": ("SELECT * FROM t LIMIT ALL", None),
    "SELECT * FROM t WHERE tag = 'rate-limit'": ("SELECT * FROM t WHERE tag = 'rate-limit'", None),
    "SELECT * FROM (SELECT 1 LIMIT 7) LIMIT 5000": ("SELECT * FROM (SELECT 1 LIMIT 7) LIMIT 5000", None),
    "SELECT * FROM (SELECT 1 LIMIT 7000) LIMIT 5": ("SELECT * FROM (SELECT 1 LIMIT 1000) LIMIT 1000", None),
    "SELECT * FROM t LIMIT 99999999999999999999999": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT * FROM t LIMIT\u30005000": ("SELECT * FROM t LIMIT 1000", None),
    "SELECT created_at, dropped, insert_time, GRANTED FROM t LIMIT 1": ("SELECT created_at, dropped, insert_time, GRANTED FROM t LIMIT 1", None),
    "SELECT Update FROM t LIMIT 1": ("SELECT Update FROM t LIMIT 1", "UPDATE"),
    "call me, then DELETE LIMIT 1": ("call me, then DELETE LIMIT 1", "DELETE"),
    "": (" LIMIT 1000", None),
}


@pytest.mark.parametrize("sql", STATEMENT_CASES)
def test_g1_g3_cases(spark, sql):
    from tracefold.operators.guard import capped_text, forbidden_keyword
    row = spark.createDataFrame([(sql,)], "sql string").select(
        capped_text(F.col("sql"), 1000).alias("c"), forbidden_keyword(F.col("sql")).alias("k")).first()
    assert (row.c, row.k) == STATEMENT_CASES[sql]


fragments = st.lists(st.sampled_from([
    "SELECT * FROM t", " LIMIT 5", " limit 5000", " LIMIT  20000", ";", "  ", " -- note", "\n",
    " WHERE tag = 'rate-limit'", " LIMIT ALL", " (SELECT 1 LIMIT 7)", " created_at", "\tLIMIT\t9"]), min_size=1, max_size=8)


@settings(max_examples=30, deadline=None)
@given(fragments)
def test_g3_is_idempotent_and_bounds_the_first_limit(spark, parts):
    import re
    from tracefold.operators.guard import capped_text
    sql = "".join(parts)
    df = spark.createDataFrame([(sql,)], "sql string").withColumn("c", capped_text(F.col("sql"), 1000))
    row = df.withColumn("again", capped_text(F.col("c"), 1000)).first()
    assert row.again == row.c
    numbers = [int(n) for n in re.findall(r"(?i)limit\s+([0-9]+)", row.c)]
    assert not numbers or numbers[0] <= 1000
    assert "limit" in row.c.lower()


# envelope text -> (message, artifact ids, has data), None if it is not one
ENVELOPE_CASES = {
    "": None, "plain": None, "[1]": None, "7": None, "null": None, "{}": None, "{": None,
    '{"type": "tool_result", "version": 1, "message": "done"}': ("done", [], False),
    '{"type": "tool_result", "version": 1.0, "message": "done"}': ("done", [], False),
    '{"type": "tool_result", "version": 2, "message": "done"}': None,
    '{"type": "tool_result", "version": "1", "message": "done"}': None,
    '{"type": "tool_result", "version": true, "message": "done"}': None,
    '{"type": "other", "version": 1, "message": "done"}': None,
    '{"type": 5, "version": 1, "message": "done"}': None,
    '{"type": "tool_result", "version": 1, "message": ""}': None,
    '{"type": "tool_result", "version": 1, "message": 3, "data": {}}': (None, [], True),
    '{"type": "tool_result", "version": 1, "data": {"success": false}}': (None, [], True),
    '{"type": "tool_result", "version": 1, "data": [1]}': None,
    '{"type": "tool_result", "version": 1, "artifacts": "x", "message": "m"}': ("m", [], False),
    '{"type": "tool_result", "version": 1, "artifacts": [5, null, {"id": 5}, {"id": "b"}]}': (None, ["b"], False),
    '{"type": "tool_result", "version": 1, "artifacts": []}': None,
}


@pytest.mark.parametrize("text", ENVELOPE_CASES)
def test_f7_cases(spark, text):
    from tracefold.functions.envelopes import parse_envelope
    e = spark.createDataFrame([(text,)], "t string").select(parse_envelope(F.col("t")).alias("e")).first().e
    got = None if e is None else (e.message, [a.id for a in (e.artifacts or [])], e.data_json is not None)
    assert got == ENVELOPE_CASES[text]


def brute_usage(u):
    def first(names):
        for n in names:
            if n in u:
                return int(u[n])
        return None
    from tracefold.schemas import COMPLETION_ALIASES, PROMPT_ALIASES, TOTAL_ALIASES
    p, c, t = first(PROMPT_ALIASES), first(COMPLETION_ALIASES), first(TOTAL_ALIASES)
    if p is None or c is None:
        return None
    return (p, c, p + c if t is None else t)


usage_dicts = st.dictionaries(st.sampled_from(["prompt_tokens", "promptTokens", "input_tokens", "inputTokens",
                                                "completion_tokens", "completionTokens", "output_tokens",
                                                "outputTokens", "total_tokens", "totalTokens", "other"]),
                              st.integers(min_value=0, max_value=10_000), max_size=6)


@settings(max_examples=30, deadline=None)
@given(usage_dicts)
def test_f4_matches_alias_rules(spark, u):
    import json as _json
    from tracefold.functions.usage import usage_struct
    r = spark.createDataFrame([(_json.dumps(u),)], "u string").select(usage_struct(F.col("u")).alias("s")).first().s
    assert (None if r is None else (r.promptTokens, r.completionTokens, r.totalTokens)) == brute_usage(u)


# approval value -> (approved, kind, message)
APPROVAL_CASES = {
    "true": (True, None, None), "false": (False, None, None), "1": (False, None, None), '"yes"': (False, None, None),
    "null": (False, None, None), "[]": (False, None, None), "{}": (False, None, None),
    '{"kind": "tool-approved"}': (True, "tool-approved", None),
    '{"kind": "tool-approved", "message": "no"}': (True, "tool-approved", None),
    '{"kind": "tool-denied"}': (False, "tool-denied", "The tool call was denied."),
    '{"kind": "tool-denied", "message": "no"}': (False, "tool-denied", "no"),
    '{"kind": "tool-denied", "message": ""}': (False, "tool-denied", ""),
    '{"kind": "tool-denied", "message": null}': (False, "tool-denied", None),
    '{"kind": "other", "message": "no"}': (False, "other", None),
    '{"kind": 3}': (False, None, None),
}


@pytest.mark.parametrize("value", APPROVAL_CASES)
def test_f1_cases(spark, value):
    from tracefold.functions.approvals import normalize_approval
    a = spark.createDataFrame([(value,)], "v string").select(normalize_approval(F.col("v")).alias("a")).first().a
    assert (a.approved, a.kind, a.message) == APPROVAL_CASES[value]


@pytest.mark.parametrize("ids", [
    [["a1"], ["a2", "a1"], [], ["a3", "a2"]], [[], []], [[7, "a2"], ["a1"]], [["a2", "a2"], ["a2"]], [None, ["a1"], None],
])
def test_w12_first_seen_order(spark, ids):
    """Ids come once, in the order in which they are first seen, and the first one is the first artifact."""
    import json
    from tracefold.schemas import CHUNKS
    rows = []
    for i, found in enumerate(ids):
        r = {f.name: None for f in CHUNKS.fields}
        text = "plain text" if found is None else json.dumps(
            {"type": "tool_result", "version": 1, "message": "m", "artifacts": [{"id": a} for a in found]})
        r.update(run_id="r", seq=i * 10, type="tool_result", tool_call_id=f"c{i}", content=text)
        rows.append(tuple(r[f.name] for f in CHUNKS.fields))
    chunks = spark.createDataFrame(rows, CHUNKS)
    want = list(dict.fromkeys(a for found in ids for a in found or [] if isinstance(a, str)))
    got = [r.artifact_id for r in sorted(RU.distinct_artifacts(chunks).collect(), key=lambda r: r.ordinal)]
    assert got == want
    assert [r.artifact_id for r in RU.first_artifact(chunks).collect()] == want[:1]
