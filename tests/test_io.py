"""Sources and sinks: CSV export (S7) read back, event-stream frames (S10/S9), artifact access."""

import glob
import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracefold.sources import derive, sse
from tracefold.sources.artifacts import artifact_data, csv_header, csv_rows, export_csv, read_artifact, write_artifact


def test_export_csv_reads_back(spark, scratch):
    rows = [("a,b", 'say "hi"', None), ("line1\nline2", "", "plain"), ("  blanks  ", "#hash", "x")]
    df = spark.createDataFrame(rows, "c1 string, c2 string, c3 string")
    path = os.path.join(scratch, "csv")
    export_csv(df, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    got = sorted((r.c1, r.c2 or "", r.c3 or "") for r in back.collect())
    want = sorted((a, b or "", c or "") for a, b, c in rows)
    assert got == want


def test_csv_rows_rule(spark):
    df = spark.createDataFrame([("a,b", 'q"x', None, ["t1", "t2"])], "a string, b string, c string, d array<string>")
    assert csv_rows(df).first().csv_line == '"a,b","q""x",,"t1,t2"'
    assert csv_header(["a", "b,c"]) == 'a,"b,c"'


def test_sse_frames_and_files(spark, scratch):
    c = derive.chunks(spark, SF_SMALL).where("type IN ('done', 'tool_call')").limit(20)
    frames = sse.encode_sse(c).collect()
    for f in frames:
        assert f.frame.startswith("data: ") and f.frame.endswith("\n\n")
        body = json.loads(f.frame[6:])
        own = {"done": {"finishReason", "usage"}, "tool_call": {"index", "toolCall"}}[body["type"]]
        assert set(body) == {"id", "model", "timestamp", "type"} | own  # a kind's NULL fields are kept
        assert body["type"] != "done" or body["usage"] is None or set(body["usage"]) >= {"totalTokens"} or body["usage"]
    path = os.path.join(scratch, "stream.txt")
    with open(path, "w", encoding="utf-8") as fh:
        for f in frames:
            fh.write(f.frame)
        fh.write(": keep-alive\n\ndata: [DONE]\n\nnot json\n")
    parsed = sse.read_sse(spark, path)
    assert parsed.count() == len(frames)
    strict = sse.read_sse(spark, path, strict=True)
    assert strict.count() == len(frames)


def test_artifact_data_modes(spark, scratch):
    ref = write_artifact(spark.range(300).withColumn("t", F.current_timestamp()), "run-xyz", scratch)
    assert ref.id.startswith("a_run-xyz_") and not ref.was_capped
    prev = artifact_data(spark, scratch, "run-xyz", ref.id, "preview", n=200)
    assert prev["status"] == "ok" and prev["preview"].count() == 200
    assert dict(prev["preview"].dtypes)["t"] == "string"  # timestamps stored as text
    dl = artifact_data(spark, scratch, "run-xyz", ref.id, "download")
    assert dl["mode"] == "download" and glob.glob(os.path.join(dl["location"], "*.parquet"))
    assert artifact_data(spark, scratch, "run-other", ref.id)["status"] == "not_found"
    assert read_artifact(spark, scratch, "run-xyz", ref.id, now="2999-01-01 00:00:00") is None  # expired


def test_schema_text_when_no_tables(spark):
    from tracefold.operators.catalog import METADATA, schema_text
    empty = spark.createDataFrame([], METADATA)
    rows = [(r.kind, r.ddl) for r in schema_text(empty).collect()]
    assert rows == [("none", "(no tables found)")]
    one = spark.createDataFrame([("t", 1, "a", "bigint", True)], METADATA)
    rows = {r.kind: r.ddl for r in schema_text(one, {"log_level": ["debug", "info"]}).collect()}
    assert rows == {"table": "CREATE TABLE t (\n    a bigint NOT NULL\n);",
                    "enum": "CREATE TYPE log_level AS ENUM ('debug', 'info');"}


def test_day_partitioned_records_prune(spark, scratch):
    from tracefold.operators import records as R
    from tracefold.sources.records import read_records, write_records
    rec = derive.load_records(spark, SF_SMALL).drop("event_id", "user_id")
    path = os.path.join(scratch, "records")
    write_records(rec, path, files_per_day=2)
    stored = spark.read.parquet(path)
    for stored_q, plain_q in [
        (R.error_rollup(stored, "2024-01-15", ["service_name", "hour"]), R.error_rollup(rec, "2024-01-15", ["service_name", "hour"])),
        (R.where_recent(stored, "2024-01-15 10:00:00", "calendar_day"), R.where_recent(rec, "2024-01-15 10:00:00", "calendar_day")),
        (R.where_recent(stored, "2024-01-15 10:00:00", "as_written"), R.where_recent(rec, "2024-01-15 10:00:00", "as_written")),
    ]:
        plan = stored_q._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan
        cols = [c for c in plain_q.columns if c != "day"]
        assert sorted(map(tuple, stored_q.select(*cols).collect())) == sorted(map(tuple, plain_q.select(*cols).collect()))
    assert read_records(spark, path).columns[:3] == ["created_at", "start_timestamp", "end_timestamp"]


def test_materialize_cuts_lineage(spark):
    from tracefold.session import checkpoint_dir, materialize
    c = derive.chunks(spark, SF_SMALL).where("type = 'done'")
    m = materialize(c, "done_chunks")
    assert m.count() == c.count()
    assert checkpoint_dir(spark) in m.inputFiles()[0]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "conversations" not in plan


def test_sse_keeps_non_ascii(spark):
    c = derive.chunks(spark, SF_SMALL).where("type = 'content' AND delta RLIKE '[^\\\\x00-\\\\x7F]'").limit(5)
    frames = [r.frame for r in sse.encode_sse(c).collect()]
    assert frames and all("\\u00" not in f for f in frames)
    assert all(any(ord(ch) > 127 for ch in f) for f in frames)


def test_every_kind_has_its_own_fields(spark):
    from tracefold.schemas import CHUNKS
    rows = []
    for i, (kind, more) in enumerate([
            ("content", dict(delta="b", content="ab", role="assistant")), ("thinking", dict(delta="t", content="t")),
            ("tool_call", dict(tool_call_id="c", tool_name="f", arguments='{"x":1}')), ("tool_result", dict(tool_call_id="c", content="r")),
            ("tool-input-available", dict(tool_call_id="c", tool_name="f", input='{"y":[1,"ü"]}')),
            ("approval-requested", dict(tool_call_id="c", tool_name="f", input='{"y":2}')),
            ("error", dict(error_message="boom")), ("done", dict(finish_reason="stop", usage='{"totalTokens":3}'))]):
        r = {f.name: None for f in CHUNKS.fields} | dict(run_id="r", seq=i, type=kind, model="m", timestamp=5) | more
        rows.append(tuple(r[f.name] for f in CHUNKS.fields))
    chunks = spark.createDataFrame(rows, CHUNKS).withColumn("index", F.lit(0))
    got = {b["type"]: b for b in (json.loads(r.frame[6:]) for r in sse.encode_sse(chunks).collect())}
    for b in got.values():
        assert (b.pop("id"), b.pop("model"), b.pop("timestamp")) == ("r", "m", 5)
        b.pop("type")
    assert got == {
        "content": {"content": "ab", "delta": "b", "role": "assistant"}, "thinking": {"content": "t", "delta": "t"},
        "tool_call": {"index": 0, "toolCall": {"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"x":1}'}}},
        "tool_result": {"toolCallId": "c", "content": "r"},
        "tool-input-available": {"toolCallId": "c", "toolName": "f", "input": {"y": [1, "ü"]}},
        "approval-requested": {"toolCallId": "c", "toolName": "f", "input": {"y": 2}, "approval": {"id": "c", "needsApproval": True}},
        "error": {"error": {"message": "boom", "code": None}}, "done": {"finishReason": "stop", "usage": {"totalTokens": 3}}}


def test_parsed_chunks_feed_the_text_fold(spark):
    from tracefold.operators.runs import accumulate_text
    from tracefold.streaming.streams import typed_chunks
    lines = [{"id": "r", "model": "m", "timestamp": 1, "type": "content", "seq": i, "content": c, "delta": d}
             for i, (c, d) in enumerate([("a", "a"), ("ab", "b"), ("abc", "c"), ("x", "x"), ("xy", "y")])]
    chunks = typed_chunks(spark.createDataFrame([(json.dumps(x),) for x in lines], "payload string"))
    parts = accumulate_text(chunks, "content", final_only=True).orderBy("last_seq").collect()
    assert [p.content for p in parts] == ["abc", "xy"]


ATTRIBUTES = ['{"a":"x","b":1}', '{"a":1}', '{"a":1.50}', '{"a":true}', '{"a":null}', '{"a":{"c":[1,"z"]}}', '{"a":["x",2]}', '{}', '[]', '["a","b"]',
              '["b",7]', '[{"a":1}]', '"a"', '7', 'null', 'not json', '', None, '{"a.b":"dot"}', '{"A":"upper"}', '{"a":""}', '{"é":"ü"}',
              '{"a":123456789012345678901234567890}', '{"a":"\\u00e9\\n"}']


def test_parsed_attributes_give_the_same_rows(spark, scratch):
    from tracefold.operators import records as R
    from tracefold.sources.records import sample_records, write_records
    ids = spark.range(len(ATTRIBUTES) * 3).select(F.col("id").alias("i"))
    texts = F.array(*[F.lit(a) for a in ATTRIBUTES])
    rec = sample_records(ids, "2024-01-15 10:00:00").withColumn(
        "attributes", F.element_at(texts, (F.substring("span_id", 6, 9).cast("int") % len(ATTRIBUTES)) + 1))
    plain, parsed = os.path.join(scratch, "plain"), os.path.join(scratch, "parsed")
    write_records(rec, plain, 2)
    write_records(rec, parsed, 2, parsed=True)
    a, b = spark.read.parquet(plain), spark.read.parquet(parsed)
    assert "attributes_variant" in b.columns
    for key in ("a", "b", "A", "a.b", "é", "z", "x", "7"):
        left, right = R.where_attr_has_key(a, key), R.where_attr_has_key(b, key)
        assert sorted(r.span_id for r in left.collect()) == sorted(r.span_id for r in right.collect()), key
        for value in ("x", "1", "1.50", "true", "", "dot", "upper", "é\n", '{"c":[1,"z"]}', '["x",2]', "ü", "123456789012345678901234567890"):
            left, right = R.where_attr_equals(a, key, value), R.where_attr_equals(b, key, value)
            assert sorted(r.span_id for r in left.collect()) == sorted(r.span_id for r in right.collect()), (key, value)
            plan = right.select("span_id")._jdf.queryExecution().executedPlan().toString()
            assert "json" not in plan.lower().replace("attributes_json_schema", "")


def test_profile_sketches_merge(spark, scratch):
    from tracefold.operators import catalog as C
    from tracefold.sources.records import write_records
    rec = derive.load_records(spark, "/root/testdata/sf0.01").drop("user_id")
    stored, kept = os.path.join(scratch, "records"), os.path.join(scratch, "sketches")
    write_records(rec, stored, 2)
    table = spark.read.parquet(stored)
    days = sorted(str(r.day) for r in table.select("day").distinct().collect())
    early = table.where(F.col("day").cast("string") < days[len(days) // 2])
    assert C.refresh_profile(spark, early, kept).where("column_name = 'span_id'").first().n_rows == early.count()
    before = spark.read.parquet(kept).count()
    got = {r.column_name: r for r in C.refresh_profile(spark, table, kept).collect()}  # reads the new days only
    assert spark.read.parquet(kept).groupBy("part", "column_name").count().where("count > 1").count() == 0
    assert spark.read.parquet(kept).count() > before
    exact = {r.column_name: r for r in C.profile("records", table.drop("day"), exact=True).collect()}
    assert set(got) == set(exact)
    n = table.count()
    for name, want in exact.items():
        r = got[name]
        assert (r.n_rows, r.n_nulls, r.min_value, r.max_value) == (want.n_rows, want.n_nulls, want.min_value, want.max_value), name
        assert abs(r.n_distinct - want.n_distinct) <= max(1, 0.06 * want.n_distinct), name
    ids = [r.event_id for r in table.select("event_id").orderBy("event_id").collect()]
    for q, value in zip((0.25, 0.5, 0.75), got["event_id"].quantiles, strict=True):
        assert abs(sum(i <= value for i in ids) / n - q) < 0.03
    assert got["level"].quantiles is None
    plan = C.profile_sketches(table)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_profile_of_no_rows_and_odd_columns(spark):
    from tracefold.operators import catalog as C
    empty = spark.createDataFrame([], "day date, a int, b string")
    assert C.merged_profile(C.profile_sketches(empty)).count() == 0
    odd = spark.createDataFrame([("2024-01-01", 10, None, [1], 1.5), ("2024-01-02", 9, None, None, None), ("2024-01-02", None, None, [1], float("nan"))],
                                "day string, a int, b string, c array<int>, d double")
    got = {r.column_name: r for r in C.merged_profile(C.profile_sketches(odd)).collect()}
    assert (got["a"].min_value, got["a"].max_value, got["a"].n_nulls) == ("9", "10", 1)  # numbers, not texts
    assert (got["b"].n_distinct, got["b"].n_nulls, got["c"].n_distinct, got["d"].n_rows) == (0, 3, 1, 3)


def test_natural_order(spark):
    from tracefold.operators import records as R
    texts = ["a10", "A2", "a1", "b", "a", "", "10", "9", "007", "7a", "a2b", "a2B1", None, "x" * 30 + "9" * 40, "x" * 30 + "1" + "0" * 40, "item 1.10", "item 1.9", "é2"]
    got = [r.t for r in R.sort_rows(spark.createDataFrame([(t,) for t in texts], "t string").repartition(4), [("t", "asc")], natural=True).collect()]
    assert got == ["", "a", "a1", "A2", "a2b", "a2B1", "a10", "b", "item 1.9", "item 1.10", "x" * 30 + "9" * 40, "x" * 30 + "1" + "0" * 40,
                   "é2", "007", "7a", "9", "10", None]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tracefold.session import checkpoint_dir
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(fake)
