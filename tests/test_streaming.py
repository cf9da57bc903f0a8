"""Streaming operators against their batch twins over the same files (availableNow)."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracefold.operators import runs as RU
from tracefold.sources import derive, sse
from tracefold.streaming import streams as ST


def run_to_memory(df, name, checkpoint, mode="append"):
    """Drive a small streaming query over everything available now into a memory table and return that table."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)



def _write_in_seq_order(df, path, parts):
    """One writer per run: a run's writes reach the stream in seq order across micro-batches.

    The file source orders files by modification time, so the seq ranges are
    appended one after another; inside a file rows are shuffled, which the folds
    must tolerate.
    """
    bounds = df.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.0)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("seq") > lo)
        if hi is not None:
            cond = cond & (F.col("seq") <= hi)
        df.where(cond).coalesce(1).sortWithinPartitions(F.rand(3)).write.mode("append").parquet(path)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_t1_stream_chunks_equals_batch(spark, scratch):
    c = derive.chunks(spark, SF_SMALL)
    frames = sse.encode_sse(c, with_seq=True).select(F.explode(F.split("frame", "\n")).alias("value"))
    path = os.path.join(scratch, "sse")
    frames.repartition(5).write.text(path)  # several files, like captured streams
    got = run_to_memory(ST.stream_chunks(spark, path, "sse", max_files_per_trigger=2), "t1_chunks",
                           os.path.join(scratch, "ck"))
    cols = ["run_id", "seq", "type", "tool_call_id", "tool_name", "finish_reason", "error_message", "delta"]
    assert _rows(got, cols) == _rows(c, cols)


def test_t2_error_rollup_closed_windows(spark, scratch):
    rec = derive.load_records(spark, SF_SMALL)
    path = os.path.join(scratch, "records")
    rec.select("start_timestamp", "level", "service_name").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_to_memory(ST.stream_error_rollup(stream, "1 day"), "t2_rollup", os.path.join(scratch, "ck"))
    max_t = rec.agg(F.max("start_timestamp")).first()[0]
    want = ST.error_rollup_closed(rec, max_t, "1 day")
    cols = ["window_start", "service_name", "n_errors"]
    assert _rows(got, cols) == _rows(want, cols)
    assert got.count() > 0


def test_t3_run_state_matches_batch_fold(spark, scratch):
    upd = derive.run_updates(spark, SF_SMALL)
    path = os.path.join(scratch, "updates")
    _write_in_seq_order(upd, path, 4)
    stream = spark.readStream.schema(upd.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run_to_memory(ST.stream_run_state(stream), "t3_state", os.path.join(scratch, "ck"), mode="update")
    latest = spark.table("t3_state").where("exists")
    # update mode emits a row per batch; the last one per run is the state
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy(F.col("updated_at").desc(), F.col("n_writes").desc())
    final = latest.withColumn("r", F.row_number().over(w)).where("r = 1")
    want = RU.fold_run_state(upd)
    cols = ["run_id", "messages", "pending", "model", "n_writes"]
    got_rows = {r[0]: r for r in _rows(final, cols)}
    want_rows = {r[0]: r for r in _rows(want, cols)}
    # runs whose last write is a clear have no state in the batch fold
    assert {k: v for k, v in got_rows.items() if k in want_rows} == want_rows


def test_t4_approvals_join(spark, scratch):
    c = derive.chunks(spark, SF_SMALL).where("type = 'approval-requested'") \
        .select("run_id", "tool_call_id", F.timestamp_millis("timestamp").alias("event_time"))
    d = derive.approvals(spark, SF_SMALL)
    rp, dp = os.path.join(scratch, "req"), os.path.join(scratch, "dec")
    c.write.parquet(rp)
    d.write.parquet(dp)
    # a late sentinel on both sides moves the watermarks past every bound
    sentinel_t = c.agg(F.max("event_time")).first()[0]
    spark.createDataFrame([("run-sentinel", "x", sentinel_t)], c.schema) \
        .withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(rp)
    spark.createDataFrame([("run-sentinel", "x", 1, "true", sentinel_t)],
                          "run_id string, tool_call_id string, seq long, value string, decided_at timestamp") \
        .withColumn("decided_at", F.col("decided_at") + F.expr("INTERVAL 1 DAY")) \
        .select(*d.columns).write.mode("append").parquet(dp)
    rs = spark.readStream.schema(c.schema).parquet(rp)
    ds = spark.readStream.schema(d.schema).parquet(dp)
    got = run_to_memory(ST.stream_approvals(rs, ds, "5 minutes"), "t4_appr", os.path.join(scratch, "ck"))
    want = ST.approvals_batch(c, d, "5 minutes")
    cols = ["run_id", "tool_call_id", "status"]
    got_rows = [r for r in _rows(got, cols) if r[0] != "run-sentinel"]
    assert got_rows == _rows(want, cols)
    assert {r[2] for r in got_rows} == {"decided", "timed_out"}


def test_t5_activity_sessions(spark, scratch):
    c = derive.chunks(spark, SF_SMALL).select("run_id", F.timestamp_millis("timestamp").alias("event_time"))
    path = os.path.join(scratch, "c")
    c.write.parquet(path)
    last = c.agg(F.max("event_time")).first()[0]
    spark.createDataFrame([("run-sentinel", last)], c.schema) \
        .withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 DAY")).write.mode("append").parquet(path)
    s = spark.readStream.schema(c.schema).parquet(path)
    got = run_to_memory(ST.stream_activity_sessions(s), "t5_sess", os.path.join(scratch, "ck"))
    want = ST.activity_sessions_batch(c)
    cols = ["run_id", "session_start", "session_end", "n_chunks"]
    assert [r for r in _rows(got, cols) if r[0] != "run-sentinel"] == _rows(want, cols)
    # batch idle gaps and stream sessions agree: sessions = gaps + 1 per run
    gaps = RU.idle_gaps(derive.chunks(spark, SF_SMALL)).groupBy("run_id").count()
    sess = want.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    j = sess.join(gaps, "run_id", "left").select("n", F.coalesce("count", F.lit(0)).alias("g"))
    assert j.where("n != g + 1").count() == 0


def test_t3_compacted_run_state_matches_batch_fold(spark, scratch):
    upd = derive.run_updates(spark, SF_SMALL)
    path = os.path.join(scratch, "updates")
    _write_in_seq_order(upd, path, 6)
    stream = spark.readStream.schema(upd.schema).option("maxFilesPerTrigger", 1).parquet(path)
    summaries = os.path.join(scratch, "summaries")
    q = ST.stream_run_state_compacted(stream, summaries, os.path.join(scratch, "ck"), bucket_width=16)
    q.awaitTermination()
    state = ST.read_run_state(spark, summaries)
    cols = ["run_id", "messages", "pending", "model", "created_at", "updated_at", "n_writes"]
    assert _rows(state, cols) == _rows(RU.fold_run_state(upd), cols)
    # several micro-batches were folded
    assert len([f for f in os.listdir(summaries) if f.startswith("batch=")]) > 1


def test_t1_stream_chunks_json_lines(spark, scratch):
    c = derive.chunks(spark, SF_SMALL).where("type <> 'content'")
    path = os.path.join(scratch, "jsonl")
    c.select(sse.chunk_json(c, with_seq=True).alias("value")).repartition(3).write.text(path)
    got = run_to_memory(ST.stream_chunks(spark, path, "json"), "t1_jsonl", os.path.join(scratch, "ck"))
    c = c.withColumns({k: F.to_json(F.try_parse_json(k)) for k in ("input", "usage")})  # JSON values: their keys come sorted
    cols = ["run_id", "seq", "type", "tool_call_id", "tool_name", "arguments", "input", "finish_reason", "usage"]
    assert _rows(got, cols) == _rows(c, cols)


def test_t2_late_rows_are_dropped(spark, scratch):
    import datetime as dt
    schema = "start_timestamp timestamp, level string, service_name string"
    t0 = dt.datetime(2024, 1, 15, 10, 0, 0)
    first = [(t0 + dt.timedelta(minutes=m), "error", "svc-1") for m in range(0, 300, 7)]
    path = os.path.join(scratch, "late")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = (ST.stream_error_rollup(stream, "1 hour", "10 minutes").writeStream.outputMode("append")
         .format("memory").queryName("t2_late").option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    # an error from the first hour arrives after the watermark (max time - 10 min) has passed that window
    late = [(t0 + dt.timedelta(minutes=5), "error", "svc-1"), (t0 + dt.timedelta(minutes=400), "error", "svc-1")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    got = {r.window_start: r.n_errors for r in spark.table("t2_late").collect()}
    first_hour = sum(1 for t, _, _ in first if t < t0 + dt.timedelta(hours=1))
    assert got[t0] == first_hour  # the late row did not change the closed window


# ---------------------------------------------------------------------------
# keyed state: any order, expiry, restart, silent time-outs
# ---------------------------------------------------------------------------

UPDATES = "run_id string, seq long, kind string, messages string, pending string, model string, written_at timestamp"
OUT = ["run_id", "messages", "pending", "model", "created_at", "updated_at", "n_writes"]


def random_writes(seed, n=300):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 15, 10)
    rows, seqs = [], {}
    for _ in range(n):
        run = rnd.choice(["hot", "hot", "a", "b", "c"])
        seqs[run] = seq = seqs.get(run, 0) + rnd.randint(1, 3)
        kind = rnd.choices(["set_messages", "set_pending", "clear"], weights=[5, 5, 1])[0]
        rows.append((run, seq, kind, f"m{seq}" if kind == "set_messages" else None,
                     f"p{seq}" if kind == "set_pending" and rnd.random() < 0.7 else None,
                     rnd.choice([None, "x", "y"]) if kind != "clear" else None, t0 + dt.timedelta(seconds=seq)))
    rnd.shuffle(rows)  # writes reach the stream in any order
    return rows


def latest_states(table):
    """Update mode gives a row a batch and run; the last one counts."""
    return {r.run_id: tuple(r[c] for c in OUT) if r["exists"] else None for r in table.collect()}


def test_t3_writes_and_clears_in_any_order(spark, scratch):
    rows, path = random_writes(1), os.path.join(scratch, "in")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k: k + 40], UPDATES).repartition(3).write.mode("append").parquet(path)
    spark.createDataFrame([], UPDATES).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 4).parquet(path)
    state = latest_states(run_to_memory(ST.stream_run_state(stream, late_seconds=86_400), "t3_any", os.path.join(scratch, "ck"), "update"))
    want = {r[0]: r for r in _rows(RU.fold_run_state(spark.createDataFrame(rows, UPDATES)), OUT)}
    assert {k: v for k, v in state.items() if v} == want and set(state) == {r[0] for r in rows}


def test_t3_goes_on_after_a_restart(spark, scratch):
    rows, path, ck = random_writes(2), os.path.join(scratch, "in"), os.path.join(scratch, "ck")
    out = os.path.join(scratch, "out")
    for part in (rows[:150], rows[150:]):  # two runs of the query on one checkpoint
        spark.createDataFrame(part, UPDATES).coalesce(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(UPDATES).parquet(path)
        (ST.stream_run_state(stream, late_seconds=86_400).writeStream.outputMode("update").option("checkpointLocation", ck)
         .foreachBatch(lambda batch, n: batch.write.parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination())
    state = latest_states(spark.read.parquet(out).orderBy("batch"))
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
    want = {r[0]: r for r in _rows(RU.fold_run_state(spark.createDataFrame(rows, UPDATES)), OUT)}
    assert {k: v for k, v in state.items() if v} == want


def until(condition, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.3)
    return False


def start_ticking(df, name, checkpoint, mode="append"):
    return (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
            .trigger(processingTime="300 milliseconds").start())


def utc_now():
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def test_t3_idle_runs_leave(spark, scratch):
    path, now = os.path.join(scratch, "in"), utc_now()
    write = lambda rows: spark.createDataFrame(rows, UPDATES).coalesce(1).write.mode("append").parquet(path)
    write([("a", 1, "set_messages", "old", None, "x", now)])
    stream = spark.readStream.schema(UPDATES).parquet(path)
    q = start_ticking(ST.stream_run_state(stream, idle_seconds=3, late_seconds=60), "t3_idle", os.path.join(scratch, "ck"), "update")
    try:
        assert until(lambda: spark.table("t3_idle").count() == 1)
        time.sleep(8)  # nothing comes; the timer drops the run
        write([("a", 2, "set_pending", None, "new", None, now)])
        assert until(lambda: spark.table("t3_idle").count() == 2)
        rows = {r.n_writes: r for r in spark.table("t3_idle").where("pending = 'new'").collect()}
        assert list(rows) == [1] and rows[1].messages is None  # it starts anew
    finally:
        q.stop()


def test_t3_snapshots_bound_the_folders(spark, scratch):
    upd = derive.run_updates(spark, SF_SMALL).where("run_id < 'run-00000012'")
    path, summaries, ck = (os.path.join(scratch, x) for x in ("in", "sum", "ck"))
    _write_in_seq_order(upd, path, 12)
    stream = spark.readStream.schema(upd.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ST.stream_run_state_compacted(stream, summaries, ck, bucket_width=16, snapshot_every=3).awaitTermination()
    folders = [f for f in os.listdir(summaries) if "=" in f]
    assert len(folders) <= 3 + 3 + 2 and any(f.startswith("snapshot=") for f in folders)
    last, batches = ST._summary_folders(spark, summaries)
    assert last >= 0 and len(batches) < 3
    assert _rows(ST.read_run_state(spark, summaries), OUT) == _rows(RU.fold_run_state(upd), OUT)
    # goes on from the snapshot after a restart
    more = spark.createDataFrame([("run-new", 1, "set_messages", "m", None, "x", utc_now())], UPDATES).select(*upd.columns)
    more.coalesce(1).write.mode("append").parquet(path)
    ST.stream_run_state_compacted(stream, summaries, ck, bucket_width=16, snapshot_every=3).awaitTermination()
    assert _rows(ST.read_run_state(spark, summaries), OUT) == _rows(RU.fold_run_state(upd.unionByName(more)), OUT)


REQUESTS, DECISIONS = "run_id string, tool_call_id string, event_time timestamp", "run_id string, tool_call_id string, decided_at timestamp, value string"


def test_t4_a_silent_stream_times_out(spark, scratch):
    rp, dp, now = os.path.join(scratch, "req"), os.path.join(scratch, "dec"), utc_now()
    ago = lambda s: now - dt.timedelta(seconds=s)
    requests = [("r", "answered", now), ("r", "silent", now), ("r", "late", ago(100)), ("r", "early", now), ("q", "twice", ago(2)), ("q", "twice", now)]
    decisions = [("r", "answered", now + dt.timedelta(seconds=1), "true"), ("r", "late", ago(1), "true"), ("r", "early", now, None),
                 ("q", "twice", ago(1), "false"), ("x", "unasked", now, "true")]
    spark.createDataFrame(decisions, DECISIONS).write.parquet(dp)
    spark.createDataFrame([], REQUESTS).coalesce(1).write.parquet(rp)
    rs, ds = spark.readStream.schema(REQUESTS).parquet(rp), spark.readStream.schema(DECISIONS).parquet(dp)
    q = start_ticking(ST.stream_approval_outcomes(rs, ds, 3, 2), "t4_silent", os.path.join(scratch, "ck"))
    try:
        assert until(lambda: q.lastProgress is not None)
        spark.createDataFrame(requests, REQUESTS).coalesce(1).write.mode("append").parquet(rp)  # after the decisions
        # nothing else ever comes: the clock alone times the others out
        assert until(lambda: spark.table("t4_silent").count() >= len(requests))
        time.sleep(1)
        cols = ["run_id", "tool_call_id", "event_time", "decided_at", "value", "status"]
        got = sorted(map(str, spark.table("t4_silent").select(*cols).collect()))
        want = ST.approval_outcomes(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(decisions, DECISIONS), 3)
        assert got == sorted(map(str, want.select(*cols).collect()))
        assert sum("timed_out" in r for r in got) == 3
    finally:
        q.stop()


def test_t10_artifacts_expire_on_a_silent_stream(spark, scratch):
    from tracefold.operators.artifacts import expire
    from tracefold.schemas import ARTIFACT_MANIFEST
    path, now = os.path.join(scratch, "manifest"), utc_now()

    def write(rows):
        full = [(run, art, "table", 1, 1, False, 1, at, "x") for run, art, at in rows]
        spark.createDataFrame(full, ARTIFACT_MANIFEST).coalesce(1).write.mode("append").parquet(path)
    ago = lambda s: now - dt.timedelta(seconds=s)
    first = [("r", "short", ago(54)), ("r", "long", now), ("r", "dead", ago(90)), ("r", "again", ago(54)), ("r", "stale", ago(1))]
    write(first)
    q = start_ticking(ST.stream_artifact_life(spark.readStream.schema(ARTIFACT_MANIFEST).parquet(path), 60), "t10_life", os.path.join(scratch, "ck"))
    live = lambda: {r.artifact_id for r in ST.live_artifacts(spark.table("t10_life")).collect()}
    try:
        assert until(lambda: spark.table("t10_life").count() >= 4)
        # a later registration prolongs, one that comes late but is older changes nothing
        write([("r", "again", ago(10)), ("r", "stale", ago(50))])
        assert until(lambda: spark.table("t10_life").where("event = 'expired'").count() >= 1)
        time.sleep(3)
        assert live() == {"long", "again", "stale"}
        newest = spark.read.schema(ARTIFACT_MANIFEST).parquet(path).groupBy("run_id", "artifact_id").agg(F.max("created_at").alias("created_at"))
        at = utc_now().strftime("%Y-%m-%d %H:%M:%S")
        assert {r.artifact_id for r in expire(newest.withColumn("x", F.lit(1)), at, 1).collect()} == live()
    finally:
        q.stop()


def test_t1_frames_without_numbers_feed_the_folds(spark, scratch):
    """Frames as a client receives them -> files of captures -> the stream -> W1, J2 and N3 as on the log itself."""
    from pyspark.sql import Window
    c = derive.chunks(spark, SF_SMALL)
    part = Window.partitionBy("run_id", derive.turn_of(F.col("seq")), "type").orderBy("seq")
    told = c.withColumn("content", F.when(F.col("type").isin("content", "thinking"), F.concat_ws("", F.collect_list("delta").over(part)))
                        .otherwise(F.col("content")))
    frames = sse.encode_sse(told).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    assert "seq" not in frames.select(F.col("f")[0]["frame"]).first()[0]
    # a run's response is cut in two captures, as when it is continued
    half = (F.size("f") / 2).cast("int")
    captures = frames.select(F.explode(F.array(F.slice("f", 1, half), F.slice(F.col("f"), half + 1, F.size("f") - half))).alias("f")).select(
        F.concat(F.lit(": keep-alive\n\n"), F.array_join(F.transform("f", lambda x: x["frame"]), "")).alias("value"))
    path = os.path.join(scratch, "captures")
    os.makedirs(path)
    for k, r in enumerate(captures.collect()):  # a file holds one capture
        with open(os.path.join(path, f"{k}.txt"), "w", encoding="utf-8") as f:
            f.write(r.value + "data: [DONE]\n\n")
    run_to_memory(ST.stream_chunks(spark, path, max_files_per_trigger=20), "t1_folds", os.path.join(scratch, "ck")).write.parquet(os.path.join(scratch, "log"))
    got = spark.read.parquet(os.path.join(scratch, "log"))  # a memory sink's table cannot be joined with itself
    assert got.count() == c.count() and got.groupBy("run_id", "seq").count().where("count > 1").count() == 0
    for kind in ("content", "thinking"):
        finals = [RU.accumulate_text(x, kind, final_only=True).select("run_id", "content", "n_deltas") for x in (got, c)]
        assert _rows(finals[0], ["run_id", "content", "n_deltas"]) == _rows(finals[1], ["run_id", "content", "n_deltas"])
    none = derive.approvals(spark, SF_SMALL).where("false")
    pending = [RU.pending_approvals(x, none) for x in (got, c)]
    assert _rows(pending[0], ["run_id", "tool_call_id", "tool_name"]) == _rows(pending[1], ["run_id", "tool_call_id", "tool_name"])
    usage = [RU.usage_by_run(x) for x in (got, c)]
    assert _rows(usage[0], usage[0].columns) == _rows(usage[1], usage[1].columns)
    assert _rows(got.where("type = 'tool_call'"), ["index"]) == [(None,)] * got.where("type = 'tool_call'").count()


def test_a_row_without_a_place_is_not_lost(spark):
    import pytest
    lost = spark.createDataFrame([("r", None, "content", True, "x", 0)], "run_id string, seq long, type string, is_start boolean, delta string, part_index long")
    with pytest.raises(Exception, match="needs an order value"):
        RU.accumulate_text(lost, "content", final_only=True).collect()
