"""Structured Streaming operators.

Each one has a batch twin in ``tracefold.operators`` and the tests run both
over the same files (``trigger(availableNow=True)``) and compare.  Event time
is a TIMESTAMP column (``withWatermark`` refuses TIMESTAMP_NTZ).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runs import fold_run_state_summaries, merge_run_state_summaries, run_state_summary
from ..schemas import ARTIFACT_TTL_MINUTES, CHUNKS, KEEPALIVE_SECONDS
from ..sources.sse import capture_lines, parse_sse_lines
from . import stateful

# ---------------------------------------------------------------------------
# ingest
# ---------------------------------------------------------------------------

# The fields of the wire's frames (all kinds in one), by their wire names.
WIRE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("content", T.StringType()),
    T.StructField("delta", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("toolCallId", T.StringType()), T.StructField("toolName", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("toolCall", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("function", T.StructType([T.StructField("name", T.StringType()),
                                                T.StructField("arguments", T.StringType())]))])),
    T.StructField("error", T.StructType([T.StructField("message", T.StringType()),
                                         T.StructField("code", T.StringType())])),
    T.StructField("finishReason", T.StringType()), T.StructField("usage", T.StringType()),
])


def typed_chunks(parsed: DataFrame, payload: str = "payload", seq: str | None = None) -> DataFrame:
    """Wire JSON -> the wide chunk table (per-kind columns NULL elsewhere), ``index``, ``error_code`` and the event time.

    ``seq`` names a column with the place of frames that carry none themselves.
    """
    own = F.col("w.seq") if seq is None else F.coalesce(F.col("w.seq"), F.col("__seq"))
    kept = [] if seq is None else [F.col(seq).alias("__seq")]
    is_text = F.col("w.type").isin("content", "thinking")
    return parsed.select(F.from_json(F.col(payload), WIRE).alias("w"), *kept).select(
        F.col("w.id").alias("run_id"), own.alias("seq"), F.col("w.type").alias("type"),
        F.col("w.model").alias("model"), F.col("w.timestamp").alias("timestamp"),
        # the wire has no part index; a text part starts where the accumulated content is the delta itself
        F.when(is_text, F.lit(0).cast("long")).alias("part_index"),
        F.when(is_text, F.coalesce(F.col("w.content") == F.col("w.delta"), F.lit(False))).alias("is_start"),
        F.col("w.delta").alias("delta"), F.col("w.role").alias("role"),
        F.coalesce(F.col("w.toolCallId"), F.col("w.toolCall.id")).alias("tool_call_id"),
        F.coalesce(F.col("w.toolName"), F.col("w.toolCall.function.name")).alias("tool_name"),
        F.col("w.toolCall.function.arguments").alias("arguments"), F.col("w.input").alias("input"),
        F.col("w.content").alias("content"), F.col("w.error.message").alias("error_message"),
        F.col("w.finishReason").alias("finish_reason"), F.col("w.usage").alias("usage"),
        F.col("w.index").alias("index"), F.col("w.error.code").alias("error_code"),
        F.timestamp_millis(F.col("w.timestamp")).alias("event_time"))


def ingest_captures(captures: DataFrame, col: str = "value") -> DataFrame:
    """T1 over captures, one whole capture a row (batch or stream): chunks in the order of their capture."""
    return typed_chunks(parse_sse_lines(capture_lines(captures, col), col), seq="capture_seq")


def stream_chunks(spark: SparkSession, path: str, fmt: str = "sse", max_files_per_trigger: int | None = None) -> DataFrame:
    """Files of captured frames as a stream: event-stream text (``'sse'``) or one JSON chunk per line (``'json'``).

    A file is one capture, that of one response, and is read as one row, so that its order is kept; ``seq`` comes from
    the frames where they have one, else from the capture (``sse.capture_lines``).
    """
    if fmt not in ("sse", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return ingest_captures(reader.format("text").option("wholetext", True).load(path))


# ---------------------------------------------------------------------------
# Error roll-up over event-time windows
# ---------------------------------------------------------------------------

def stream_error_rollup(records: DataFrame, window: str = "1 hour", late: str = "10 minutes",
                        time_col: str = "start_timestamp") -> DataFrame:
    """Errors per (window, service); rows later than ``late`` behind the watermark are dropped; append mode."""
    return (records.where(F.col("level") == "error")
            .withWatermark(time_col, late)
            .groupBy(F.window(time_col, window).alias("w"), "service_name")
            .agg(F.count(F.lit(1)).alias("n_errors"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "service_name", "n_errors"))


def error_rollup_closed(records: DataFrame, max_event_time, window: str = "1 hour", late: str = "10 minutes",
                        time_col: str = "start_timestamp") -> DataFrame:
    """Batch twin of T2: the windows an append-mode stream has closed once it saw ``max_event_time``."""
    watermark = F.lit(max_event_time).cast("timestamp") - F.expr(f"INTERVAL {late}")
    out = (records.where(F.col("level") == "error")
           .groupBy(F.window(time_col, window).alias("w"), "service_name")
           .agg(F.count(F.lit(1)).alias("n_errors")))
    return out.where(F.col("w.end") <= watermark).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "service_name", "n_errors")


# ---------------------------------------------------------------------------
# Run state, incrementally
# ---------------------------------------------------------------------------

def stream_run_state(updates: DataFrame, idle_seconds: int | None = None, late_seconds: int = 600) -> DataFrame:
    """W10 incrementally (update mode, one state row per run that had writes).

    Each task folds its rows first (``stateful.partial_folds``), so a run with a third of a batch's rows sends one row
    a task to its state. Writes and clears may come in any order within ``late_seconds`` of the run's newest write.
    With ``idle_seconds`` the state of idle and of cleared runs leaves (``stateful.RunState``); the query then runs on
    processing time, which ``availableNow`` never finishes.
    """
    stateful.use_rocksdb(updates.sparkSession)
    columns = updates.select("run_id", F.col("seq").cast("long").alias("seq"), "kind", "messages", "pending", "model",
                             F.unix_micros(F.col("written_at").cast("timestamp")).alias("written_at"))
    folded = columns.mapInArrow(stateful.partial_folds, stateful.PARTIAL)
    idle = idle_seconds * 1000 if idle_seconds else None
    return _timed(folded.groupBy("run_id").transformWithState(
        stateful.RunState(idle, late_seconds * 1000), stateful.RUN_STATE_OUT, "update", "processingTime" if idle else "none"),
        "created_at", "updated_at")


def _timed(df: DataFrame, *columns: str) -> DataFrame:
    """Microseconds as timestamps."""
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


BATCH, SNAPSHOT = "batch", "snapshot"


def _summary_folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last whole snapshot's batch id (-1: none) and the ids of the whole batch folders behind it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {BATCH: [], SNAPSHOT: []}
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, number = entry.getPath().getName().partition("=")
        # a folder counts once its write has been committed
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    last = max(found[SNAPSHOT], default=-1)
    return last, sorted(n for n in found[BATCH] if n > last)


def _summaries(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The summaries that make up the current state: one snapshot and the batches behind it."""
    last, batches = _summary_folders(spark, path)
    parts = [spark.read.parquet(f"{path}/{SNAPSHOT}={last}").withColumn("batch_id", F.lit(last).cast("long"))] if last >= 0 else []
    batches = [n for n in batches if upto is None or n <= upto]
    if batches:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}={n}" for n in batches])
        parts.append(rows.withColumn("batch_id", F.col(BATCH).cast("long")).drop(BATCH))
    if not parts:
        raise FileNotFoundError(f"no run state under {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_run_state_compacted(updates: DataFrame, summary_path: str | None = None, checkpoint: str | None = None,
                               name: str = "run_state", bucket_width: int = 4096, snapshot_every: int = 20):
    """T3 without keyed state: each micro-batch is summarised per (run, seq bucket) with partial aggregates
    (``operators.runs.run_state_summary``) and written to ``summary_path/batch=<n>`` (overwritten on retry, so a re-run
    batch does not count twice). Every ``snapshot_every`` batches the last snapshot and the batches behind it are folded
    into one row a run (``snapshot=<n>``); older folders are not read again, and those that the snapshot before
    already covered are deleted. Read the state with ``read_run_state(spark, summary_path)``. Returns the started query.
    """
    from ..session import checkpoint_dir
    root = checkpoint_dir(updates.sparkSession).rstrip("/")
    summary_path = (summary_path or f"{root}/{name}/summaries").rstrip("/")
    checkpoint = checkpoint or f"{root}/{name}/checkpoint"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sliced = batch.withColumn("slice", F.floor(F.col("seq") / F.lit(bucket_width)))
        run_state_summary(sliced, ["slice"]).write.mode("overwrite").parquet(f"{summary_path}/{BATCH}={batch_id}")
        if (batch_id + 1) % snapshot_every == 0:
            before, _ = _summary_folders(spark, summary_path)
            if before < batch_id:
                folded = merge_run_state_summaries(_summaries(spark, summary_path, batch_id), F.struct("slice", "batch_id"))
                folded.write.mode("overwrite").parquet(f"{summary_path}/{SNAPSHOT}={batch_id}")
                _forget(spark, summary_path, before)

    return (updates.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _forget(spark: SparkSession, path: str, upto: int) -> None:
    """Delete the batches that an older snapshot covers, and the snapshots before it; its readers are long done."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):
        kind, _, number = entry.getPath().getName().partition("=")
        if (kind == BATCH and int(number) <= upto) or (kind == SNAPSHOT and int(number) < upto):
            fs.delete(entry.getPath(), True)


def read_run_state(spark: SparkSession, summary_path: str) -> DataFrame:
    """Current run state from the folders of ``stream_run_state_compacted``: the last snapshot and what follows it.

    Slices are ordered by (seq bucket, batch): a bucket split over two batches keeps its seq order because a run's
    writes arrive in order.
    """
    return fold_run_state_summaries(_summaries(spark, summary_path.rstrip("/")), F.struct("slice", "batch_id"))


# ---------------------------------------------------------------------------
# T4: approvals, stream-stream join
# ---------------------------------------------------------------------------

def stream_approvals(requests: DataFrame, decisions: DataFrame, bound: str = "10 minutes",
                     late: str = "1 minute") -> DataFrame:
    """T4: each approval request with its decision, or ``timed_out`` when none came within ``bound``.

    ``requests``: (run_id, tool_call_id, event_time); ``decisions``: (run_id,
    tool_call_id, decided_at, value).  Left outer stream-stream join with
    watermarks on both sides and a time-range condition, so state is dropped
    once a request can no longer be answered.
    """
    r = requests.withWatermark("event_time", late).alias("r")
    d = (decisions.select(F.col("run_id").alias("d_run"), F.col("tool_call_id").alias("d_id"), "decided_at", "value")
         .withWatermark("decided_at", late).alias("d"))
    cond = ((F.col("r.run_id") == F.col("d.d_run")) & (F.col("r.tool_call_id") == F.col("d.d_id"))
            & (F.col("d.decided_at") >= F.col("r.event_time"))
            & (F.col("d.decided_at") <= F.col("r.event_time") + F.expr(f"INTERVAL {bound}")))
    j = r.join(d, cond, "leftOuter")
    return j.select("r.run_id", "r.tool_call_id", "r.event_time", "d.decided_at", "d.value",
                    F.when(F.col("d.decided_at").isNull(), F.lit("timed_out")).otherwise(F.lit("decided")).alias("status"))


def stream_approval_outcomes(requests: DataFrame, decisions: DataFrame, bound_seconds: int = 600,
                             late_seconds: int = 60) -> DataFrame:
    """T4 on the clock: each request with its first decision within the bound, or ``timed_out`` (``stateful.ApprovalOutcome``).

    Same inputs as ``stream_approvals``. A time-out needs no later traffic: a processing-time timer fires
    ``late_seconds`` after the bound. State is keyed by (run, tool call), so a hot run is spread over all tasks.
    """
    stateful.use_rocksdb(requests.sparkSession)
    asked = requests.select("run_id", "tool_call_id", F.lit("request").alias("kind"), F.unix_micros("event_time").alias("at"),
                            F.lit(None).cast("string").alias("value"))
    told = decisions.select("run_id", "tool_call_id", F.lit("decision").alias("kind"), F.unix_micros("decided_at").alias("at"), "value")
    return _timed(asked.unionByName(told).groupBy("run_id", "tool_call_id").transformWithState(
        stateful.ApprovalOutcome(bound_seconds * 1000, late_seconds * 1000), stateful.OUTCOME, "append", "processingTime"),
        "event_time", "decided_at")


def approval_outcomes(requests: DataFrame, decisions: DataFrame, bound_seconds: int = 600) -> DataFrame:
    """Batch twin of ``stream_approval_outcomes``: the first decision within the bound, one row a request.

    An equi-join on (run, tool call), then one aggregate per request.
    """
    end = F.col("event_time") + F.make_dt_interval(secs=F.lit(bound_seconds))
    r = requests.select("run_id", "tool_call_id", "event_time").withColumn("__until", end)
    d = decisions.select(F.col("run_id").alias("__run"), F.col("tool_call_id").alias("__id"), "decided_at", "value")
    fits = ((F.col("run_id") == F.col("__run")) & (F.col("tool_call_id") == F.col("__id"))
            & F.col("decided_at").between(F.col("event_time"), F.col("__until")))
    first = F.min(F.when(F.col("decided_at").isNotNull(), F.struct("decided_at", "value")))
    return (r.join(d, fits, "left").groupBy("run_id", "tool_call_id", "event_time").agg(first.alias("d"))
            .select("run_id", "tool_call_id", "event_time", "d.decided_at", "d.value",
                    F.when(F.col("d").isNull(), F.lit("timed_out")).otherwise(F.lit("decided")).alias("status")))


def approvals_batch(requests: DataFrame, decisions: DataFrame, bound: str = "10 minutes") -> DataFrame:
    """Batch twin of T4."""
    r = requests.alias("r")
    d = decisions.select(F.col("run_id").alias("d_run"), F.col("tool_call_id").alias("d_id"), "decided_at", "value").alias("d")
    cond = ((F.col("r.run_id") == F.col("d.d_run")) & (F.col("r.tool_call_id") == F.col("d.d_id"))
            & (F.col("d.decided_at") >= F.col("r.event_time"))
            & (F.col("d.decided_at") <= F.col("r.event_time") + F.expr(f"INTERVAL {bound}")))
    return r.join(d, cond, "left").select(
        "r.run_id", "r.tool_call_id", "r.event_time", "d.decided_at", "d.value",
        F.when(F.col("d.decided_at").isNull(), F.lit("timed_out")).otherwise(F.lit("decided")).alias("status"))


# ---------------------------------------------------------------------------
# T5: idle sessions
# ---------------------------------------------------------------------------

def stream_activity_sessions(chunks: DataFrame, gap_seconds: int = KEEPALIVE_SECONDS, late: str = "1 minute") -> DataFrame:
    """T5 (stream): activity sessions per run; a new session starts after more than ``gap_seconds`` of silence."""
    return (chunks.withWatermark("event_time", late)
            .groupBy("run_id", F.session_window("event_time", f"{gap_seconds} seconds").alias("s"))
            .agg(F.count(F.lit(1)).alias("n_chunks"))
            .select("run_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_chunks"))


def activity_sessions_batch(chunks: DataFrame, gap_seconds: int = KEEPALIVE_SECONDS) -> DataFrame:
    """Batch twin of T5 (the same session_window, without a watermark)."""
    return (chunks.groupBy("run_id", F.session_window("event_time", f"{gap_seconds} seconds").alias("s"))
            .agg(F.count(F.lit(1)).alias("n_chunks"))
            .select("run_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_chunks"))


# ---------------------------------------------------------------------------
# Artifacts leave at their time limit
# ---------------------------------------------------------------------------

def stream_artifact_life(manifest: DataFrame, ttl_seconds: int = ARTIFACT_TTL_MINUTES * 60) -> DataFrame:
    """T10 on the manifest as a stream: a ``live`` row when an artifact is registered, ``expired`` when its time is up.

    Needs no later traffic; a late registration that is older than the one known is ignored, and one that is too old on
    arrival never becomes live (``stateful.ArtifactLife``).
    """
    stateful.use_rocksdb(manifest.sparkSession)
    rows = manifest.where(F.col("created_at").isNotNull()).select("run_id", "artifact_id",
                                                               F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at"))
    return _timed(rows.groupBy("run_id", "artifact_id").transformWithState(
        stateful.ArtifactLife(ttl_seconds * 1000), stateful.LIFE, "append", "processingTime"), "created_at", "at")


def live_artifacts(life: DataFrame) -> DataFrame:
    """The ids that are live by the rows of ``stream_artifact_life``."""
    # at one moment an expiry comes before a new registration
    last = life.groupBy("run_id", "artifact_id").agg(F.max(F.struct("at", (F.col("event") == "live").alias("is_live"), "created_at")).alias("l"))
    return last.where(F.col("l.is_live")).select("run_id", "artifact_id", "l.created_at")


__all__ = ["stream_chunks", "ingest_captures", "typed_chunks", "stream_error_rollup", "error_rollup_closed", "stream_run_state",
           "run_state_summary", "fold_run_state_summaries", "stream_run_state_compacted", "read_run_state",
           "stream_approvals", "approvals_batch", "stream_approval_outcomes", "approval_outcomes",
           "stream_artifact_life", "live_artifacts", "stream_activity_sessions", "activity_sessions_batch", "CHUNKS"]
