
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracefold.functions import approvals as FA
from tracefold.functions import envelopes as FE
from tracefold.operators import artifacts as A
from tracefold.operators import guard as G
from tracefold.operators import records as R
from tracefold.operators import runs as RU
from tracefold.schemas import CHUNKS


def chunk_rows(spark, rows):
    full = []
    for r in rows:
        d = {f.name: None for f in CHUNKS.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in CHUNKS.fields))
    return spark.createDataFrame(full, CHUNKS)


# --- artifact store ---------------------------------------------------------

def test_artifact_id_prefix_and_counter(spark):
    df = spark.createDataFrame([("nightly-load-7", 1, dt.datetime(2024, 1, 1)), ("nightly-load-7", 2, dt.datetime(2024, 1, 2)),
                                ("", 3, dt.datetime(2024, 1, 1)), ("ab", 4, dt.datetime(2024, 1, 1))],
                               "run_id string, result_key int, created_at timestamp")
    ids = {r.result_key: r.artifact_id for r in A.assign_artifact_ids(df).collect()}
    assert ids == {1: "a_nightly-_1", 2: "a_nightly-_2", 3: "a_unknown_1", 4: "a_ab_1"}  # eight letters of the run


def test_artifact_scoped_by_run(spark):
    m = spark.createDataFrame([("spring", "a_spring_1", 2), ("autumn", "a_autumn_1", 3)], "run_id string, artifact_id string, row_count int")
    req = spark.createDataFrame([("autumn", "a_spring_1"), ("spring", "a_spring_1"), ("winter", "a_autumn_1")], "run_id string, artifact_id string")
    hits = A.lookup_artifact(m, req).collect()
    assert [(r.run_id, r.artifact_id) for r in hits] == [("spring", "a_spring_1")]


def test_ttl_zero_expires_strictly(spark):
    m = spark.createDataFrame([("r", "a", dt.datetime(2024, 1, 1, 10, 0, 0)), ("r", "b", dt.datetime(2024, 1, 1, 9, 59))],
                              "run_id string, artifact_id string, created_at timestamp")
    live = [r.artifact_id for r in A.expire(m, "2024-01-01 10:00:00", 0).collect()]
    assert live == ["a"]  # age 0 is not > 0


# --- message order (W6) ----------------------------------------------------

def test_returns_follow_the_calls_of_their_message_in_call_order(spark):
    schema = "run_id string, pos int, call_ids array<string>, return_id string"
    msgs = spark.createDataFrame([
        ("r", 0, None, None), ("r", 1, ["x", "y", None], None), ("r", 2, None, "y"), ("r", 3, ["z", "x"], None),
        ("r", 4, None, "lost"), ("r", 5, None, "x"), ("r", 6, [], None), ("r", 7, None, "z"), ("r", 8, None, "y"),
        ("r", 9, None, "gone"), ("q", 0, None, "x")], schema)
    for width in (1, 1024):
        out = sorted((r.run_id, r.new_pos, r.pos) for r in RU.order_tool_returns(msgs, width).collect())
        assert [p for run, _, p in out if run == "r"] == [0, 1, 5, 2, 8, 3, 7, 6, 4, 9]
        assert out[0] == ("q", 0, 0)


def test_orphan_returns_go_last_and_repeats_stay_together(spark):
    msgs = spark.createDataFrame([
        ("r", 0, "tool", None, "ghost"), ("r", 1, "tool", None, "c1"), ("r", 2, "assistant", "c1", None),
        ("r", 3, "tool", None, "c1"), ("r", 4, "user", None, None)],
        "run_id string, pos int, role string, call_id string, return_id string")
    out = sorted(RU.order_tool_returns(msgs).collect(), key=lambda r: r.new_pos)
    assert [r.pos for r in out] == [2, 1, 3, 4, 0]


def test_load_orders_returns_and_dump_gives_the_messages_back(spark):
    from tracefold.operators import messages as M
    calls = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
    schema = f"run_id string, pos int, role string, content string, toolCalls {calls}, toolCallId string, name string"
    two = [("x", ("find", '{"q": 1}')), ("y", ("save", "{}"))]
    rows = [("r", 0, "system", "be brief", None, None, None), ("r", 1, "user", "go", None, None, None),
            ("r", 2, "assistant", "on it", two, None, None), ("r", 3, "tool", "saved", None, "y", "save"),
            ("r", 4, "tool", "found", None, "x", "find"), ("r", 5, "assistant", "done", None, None, None),
            ("r", 6, "user", "thanks", None, None, None)]
    parts = M.load_messages(spark.createDataFrame(rows, schema))
    ordered = M.ordered_parts(parts)
    back = sorted(M.dump_messages(ordered).collect(), key=lambda r: r.pos)
    want = [rows[i] for i in (0, 1, 2, 4, 3, 5, 6)]
    assert [(r.role, r.content, [(c.id, tuple(c.function)) for c in r.toolCalls] if r.toolCalls else None, r.toolCallId, r.name)
            for r in back] == [(w[2], w[3], w[4], w[5], w[6]) for w in want]
    history = M.request_history(ordered)
    assert sorted({r.pos for r in history.collect()}) == [0, 1, 2, 3, 4, 5]
    assert M.request_history(history).count() == history.count()  # it ends with an answer now


@pytest.mark.parametrize("args,want", [
    ('{"a": 1}', '{"a": 1}'), ('"{\\"a\\": 1}"', '{"a": 1}'), ("[1]", "{}"), ("plain", "{}"), (None, "{}"), ('"x"', "{}")])
def test_call_arguments_are_decoded(spark, args, want):
    from tracefold.operators import messages as M
    assert spark.createDataFrame([(args,)], "a string").select(M.decoded_args(F.col("a")).alias("d")).first().d == want


# --- approvals --------------------------------------------------------------

@pytest.mark.parametrize("value,approved,kind,message", [
    ("true", True, None, None),
    ("false", False, None, None),
    ('{"kind":"tool-approved","override_args":{"sql":"SELECT 1"}}', True, "tool-approved", None),
    ('{"kind":"tool-denied","message":"no"}', False, "tool-denied", "no"),
    ('{"kind":"tool-denied"}', False, "tool-denied", "The tool call was denied."),
    ('{"kind":"other"}', False, "other", None),
    ('"yes"', False, None, None),
])
def test_normalize_approval(spark, value, approved, kind, message):
    r = spark.createDataFrame([(value,)], "v string").select(FA.normalize_approval(F.col("v")).alias("a")).first().a
    assert (r.approved, r.kind, r.message) == (approved, kind, message)


def test_unknown_kind_is_not_audited(spark):
    df = spark.createDataFrame([('{"kind":"other"}',), ("true",)], "v string")
    a = df.select(FA.approval_audit_fields(F.col("v")).alias("a")).where("a.approved IS NOT NULL").count()
    assert a == 1


# --- failure stream (T8) ---------------------------------------------------------

def test_error_then_done_appended(spark):
    c = chunk_rows(spark, [dict(run_id="r", seq=0, type="content", delta="hi", is_start=True, part_index=0),
                           dict(run_id="r", seq=1, type="error", error_message="boom")])
    out = RU.close_failed_runs(c).collect()
    assert [(r.seq, r.type, r.finish_reason) for r in out] == [(2, "done", "stop")]


# --- envelopes (F7) ---------------------------------------------------------------

@pytest.mark.parametrize("text,valid,first_id", [
    ('{"type":"tool_result","version":1,"message":"ok","artifacts":[{"id":"a_run-1_1","type":"table"}]}', True, "a_run-1_1"),
    ("plain text", False, None),
    ('{"version":1,"message":"no type"}', False, None),
    ('{"type":"tool_result","version":1,"message":"no artifacts"}', True, None),
    ('{"type":"tool_result","version":1}', False, None),
    ('{"type":"tool_result","version":"1","message":"string version"}', False, None),
    ('{"type":"tool_result","version":1,"artifacts":[{"id":5},{"id":"b"}]}', True, "b"),
])
def test_parse_envelope(spark, text, valid, first_id):
    e = spark.createDataFrame([(text,)], "t string").select(FE.parse_envelope(F.col("t")).alias("e")).first().e
    assert (e is not None) == valid
    if valid:
        assert (e.artifacts[0].id if e.artifacts else None) == first_id


# --- chat session state (J2, W9) ----------------------------------------------------

def test_pending_approval_until_result(spark):
    c = chunk_rows(spark, [
        dict(run_id="harvest", seq=1, type="approval-requested", tool_call_id="ask-sql", tool_name="execute_sql",
             input='{"sql":"SELECT 1"}', timestamp=1),
        dict(run_id="harvest", seq=2, type="tool-input-available", tool_call_id="save-csv", tool_name="export_csv",
             input='{"artifact_id":"a_harvest_1"}', timestamp=2),
        dict(run_id="harvest", seq=3, type="done", finish_reason="tool_calls", timestamp=3)])
    dec = spark.createDataFrame([], "run_id string, tool_call_id string, seq long, value string")
    assert [r.tool_call_id for r in RU.pending_approvals(c, dec).collect()] == ["ask-sql"]
    c2 = c.unionByName(chunk_rows(spark, [dict(run_id="harvest", seq=4, type="tool_result", tool_call_id="ask-sql",
                                                content="x", timestamp=4)]))
    assert RU.pending_approvals(c2, dec).count() == 0
    client = RU.pending_client_calls(c, spark.createDataFrame([], "run_id string, pos long, role string"), F.lit(0))
    assert [r.tool_call_id for r in client.collect()] == ["save-csv"]
    assert RU.current_run(c, F.lit("s")).first().current_run == "harvest"


# --- findings -------------------------------------------------------------------

def test_finding1_yesterday_example_keeps_today(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 9), "today"), (dt.datetime(2024, 1, 1, 12), "yesterday")],
                               "start_timestamp timestamp, k string")
    kept = [r.k for r in R.where_recent(df, "2024-01-02 10:00:00", "as_written").collect()]
    assert kept == ["today"]
    kept = [r.k for r in R.where_recent(df, "2024-01-02 10:00:00", "calendar_day").collect()]
    assert kept == ["yesterday"]
    at_midnight = [r.k for r in R.where_recent(df, "2024-01-02 00:00:00", "as_written").collect()]
    assert at_midnight == ["today"]


def _cap(spark, sql, n=1000):
    return spark.createDataFrame([(sql,)], "sql string").select(G.capped_text(F.col("sql"), n).alias("c")).first().c


def test_finding2_and_3_textual_cap(spark):
    assert _cap(spark, "SELECT * FROM records;  ") == "SELECT * FROM records LIMIT 1000"
    assert _cap(spark, "SELECT * FROM records WHERE 'rate-limit' = ANY(tags)") == \
        "SELECT * FROM records WHERE 'rate-limit' = ANY(tags)"
    assert _cap(spark, "SELECT * FROM (SELECT 1 LIMIT 5000) t LIMIT 10") == \
        "SELECT * FROM (SELECT 1 LIMIT 1000) t LIMIT 1000"
    assert _cap(spark, "SELECT * FROM (SELECT 1 LIMIT 10) t LIMIT 5000") == \
        "SELECT * FROM (SELECT 1 LIMIT 10) t LIMIT 5000"
    assert _cap(spark, "SELECT * FROM records LIMIT ALL") == "SELECT * FROM records LIMIT ALL"
    assert _cap(spark, "SELECT * FROM records -- note") == "SELECT * FROM records -- note LIMIT 1000"


def test_finding4_keyword_guard(spark):
    df = spark.createDataFrame([("SELECT * FROM records WHERE message = 'Failed to update'",),
                                ("SELECT created_at FROM records",),
                                ("DELETE FROM t; UPDATE t SET a = 1",),
                                ("WITH a AS (SELECT 1) SELECT * FROM a",)], "sql string")
    out = [(r.verdict, r.keyword) for r in G.audit_statements(df).collect()]
    assert out == [("forbidden", "UPDATE"), ("allowed", None), ("forbidden", "UPDATE"), ("not_select", None)]


def test_finding9_usage_is_last_segment(spark):
    c = chunk_rows(spark, [dict(run_id="r", seq=1, type="done", usage='{"prompt_tokens":10,"completion_tokens":5}'),
                           dict(run_id="r", seq=2, type="done", usage='{"promptTokens":1,"completionTokens":2,"totalTokens":9}')])
    r = RU.usage_by_run(c).first()
    assert (r.prompt_tokens, r.completion_tokens, r.total_tokens, r.sum_total_tokens) == (1, 2, 9, 24)


def test_finding6_empty_result_keeps_schema(spark, scratch):
    from tracefold.sources.artifacts import read_artifact, write_artifact
    df = spark.createDataFrame([], "a long, b string")
    ref = write_artifact(df, "empty-yield", scratch)
    back = read_artifact(spark, scratch, "empty-yield", ref.id)
    assert back.columns == ["a", "b"] and back.count() == 0
    assert ref.id.startswith("a_empty-yi_") and ref.row_count == 0


def test_finding5_capped_count_and_flag(spark, scratch):
    from tracefold.sources.artifacts import read_manifest, write_artifact
    ref = write_artifact(spark.range(1500), "run1", scratch, max_rows=1000)
    assert (ref.row_count, ref.was_capped) == (1000, True)
    ref2 = write_artifact(spark.range(10), "run1", scratch, max_rows=1000)
    assert ref2.id.startswith("a_run1_") and ref2.id != ref.id  # ids are random: two writers never meet
    assert (ref2.row_count, ref2.was_capped) == (10, False)
    assert read_manifest(spark, scratch).count() == 2


def test_ready_runs_null_payload_counts_as_collected(spark):
    c = chunk_rows(spark, [dict(run_id="r", seq=1, type="approval-requested", tool_call_id="c1", tool_name="x"),
                           dict(run_id="r", seq=2, type="tool-input-available", tool_call_id="c2", tool_name="y")])
    dec = spark.createDataFrame([("r", "c1", 3, "true"), ("r", "c1", 4, None)],
                                "run_id string, tool_call_id string, seq long, value string")
    r = RU.ready_runs(c.unionByName(chunk_rows(spark, [dict(run_id="r", seq=5, type="tool_result",
                                                             tool_call_id="c2", content="ok")])), dec).first()
    # the later NULL decision replaces 'true': present, but not an approval
    assert (r.n_expected_approvals, r.n_expected_results, r.n_missing, r.n_approved, r.ready) == (1, 1, 0, 0, True)
    r2 = RU.ready_runs(c, dec.limit(0)).first()
    assert (r2.n_missing, r2.ready) == (2, False)


@pytest.mark.parametrize("inp,want", [
    ('{"artifact_id":"a_1"}', "a_1"),
    ('{"artifactId":"a_2"}', "a_2"),
    ('{"artifact_id":"","input":{"artifactId":"a_3"}}', "a_3"),
    ('{"other":1}', '{"other":1}'),
    ("  a_4  ", "a_4"),
    ("   ", None),
    (None, None),
])
def test_artifact_ref(spark, inp, want):
    got = spark.createDataFrame([(inp,)], "i string").select(FE.artifact_ref(F.col("i")).alias("a")).first().a
    assert got == want


def test_sort_rows_nulls_last_and_case(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",), ("c",)], "v string")
    assert [r.v for r in R.sort_rows(df, [("v", "asc")]).collect()] == ["A", "b", "c", None]
    assert [r.v for r in R.sort_rows(df, [("v", "desc")]).collect()] == ["c", "b", "A", None]
    assert [r.v for r in R.sort_rows(df, [("v", "desc")], case_insensitive=True).collect()] == ["c", "b", "A", None]
    assert [r.v for r in R.sort_rows(df, [("v", "asc")], case_insensitive=True).collect()] == ["A", "b", "c", None]
