"""Folds over agent-run event logs (chunks, messages, decisions, run-store writes).

Sequential state machines of the reference become windows and aggregates:
latest-value state is ``max_by`` (partial aggregation, skew-safe), running
counters use ``operators.sequence`` (bucketed prefix offsets), and membership
tests are semi/anti joins on (run_id, tool_call_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.approvals import normalize_approval
from ..functions.envelopes import log_preview, parse_envelope
from ..functions.usage import finish_reason, usage_struct
from ..schemas import KEEPALIVE_SECONDS
from .sequence import lag_in_order, running_index, running_sum

RUN = "run_id"


# consecutive seq values that the bucketed counters keep in one task: a run of any length is spread over as many
# buckets as it needs, whether its seq counts 0, 1, 2, ... or leaves gaps
BUCKET = 1 << 16


def _bucket(seq: str = "seq", width: int = BUCKET) -> Column:
    return F.floor(F.col(seq) / F.lit(width))


# ---------------------------------------------------------------------------
# Accumulated text
# ---------------------------------------------------------------------------

def accumulate_text(chunks: DataFrame, kind: str = "content", final_only: bool = False,
                    bucket_width: int = BUCKET) -> DataFrame:
    """W1 (kind='content') / W2 (kind='thinking'): running text per (run, part index).

    A part start resets the text; a start with empty text emits nothing; for
    thinking, empty deltas are skipped too.  ``content`` of a row is the prefix
    of its segment's full text up to the running length, so the full text is
    built once per segment (a single message) and not once per row.
    ``final_only`` returns one row per segment with the finished text.
    """
    d = chunks.where(F.col("type") == kind).select(RUN, "part_index", "seq", "is_start", "delta")
    if kind == "thinking":
        d = d.where(F.col("is_start") | (F.coalesce(F.col("delta"), F.lit("")) != ""))
    d = running_sum(d, [RUN, "part_index"], ["seq"], F.col("is_start").cast("long"), _bucket("seq", bucket_width),
                    "segment")
    seg = [RUN, "part_index", "segment"]
    # the full text of a segment, built once per segment (one message, so bounded) in seq order
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    if final_only:
        return d.groupBy(*seg).agg(text.alias("content"), F.max("seq").alias("last_seq"),
                                   F.count(F.lit(1)).alias("n_deltas"))
    # each row takes the prefix of its segment's text up to its running length
    full = d.groupBy(*seg).agg(text.alias("__full"))
    w_run = Window.partitionBy(*seg).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (d.withColumn("__len", F.sum(F.length("delta")).over(w_run))
           .join(full, seg)
           .withColumn("content", F.substring(F.col("__full"), F.lit(1), F.col("__len").cast("int"))))
    emitted = ~(F.col("is_start") & (F.coalesce(F.col("delta"), F.lit("")) == ""))
    return out.where(emitted).select(RUN, "part_index", "segment", "seq", "delta", "content")


# ---------------------------------------------------------------------------
# Tool-call index
# ---------------------------------------------------------------------------

def index_tool_calls(chunks: DataFrame, bucket_width: int = BUCKET) -> DataFrame:
    """0-based running index of tool_call chunks over the whole run (not reset per segment)."""
    calls = chunks.where(F.col("type") == "tool_call").select(RUN, "seq", "tool_call_id", "tool_name")
    return running_index(calls, [RUN], ["seq"], _bucket("seq", bucket_width), "index")


# ---------------------------------------------------------------------------
# Tool returns moved behind their calls
# ---------------------------------------------------------------------------

ORPHAN_POS = 1 << 62


def order_tool_returns(msgs: DataFrame, bucket_width: int = 1024) -> DataFrame:
    """Each return goes behind the first message holding its call, in the order of that message's calls.

    A message holds one ``call_id`` or an array ``call_ids``. Sort key: (anchor, is_return, call ordinal, original
    position). The anchor of a return is the first position holding its call (joined on (run, call id), which
    spreads a hot run over many tasks); orphans come last in their own order, bucketed by position.
    """
    held = F.col("call_ids") if "call_ids" in msgs.columns else F.array("call_id")
    calls = (msgs.select(RUN, "pos", F.posexplode(held).alias("ord", "return_id"))
             .where(F.col("return_id").isNotNull())
             .groupBy(RUN, "return_id").agg(F.min(F.struct("pos", "ord")).alias("call")))
    is_return = F.col("return_id").isNotNull()
    others = msgs.where(~is_return).select(RUN, "pos", F.col("pos").cast("long").alias("k1"), F.lit(0).alias("k2"),
                                           F.lit(0).alias("k3"))
    orphan = F.lit(ORPHAN_POS) + F.col("pos")
    returns = (msgs.where(is_return).join(calls, [RUN, "return_id"], "left")
               .select(RUN, "pos", F.coalesce(F.col("call.pos").cast("long"), orphan).alias("k1"), F.lit(1).alias("k2"),
                       F.coalesce("call.ord", F.lit(0)).alias("k3")))
    keyed = others.unionByName(returns)
    ranked = running_index(keyed, [RUN], ["k1", "k2", "k3", "pos"], F.floor(F.col("k1") / bucket_width), "new_pos")
    return ranked.select(RUN, "pos", "new_pos")


# ---------------------------------------------------------------------------
# Per-run latest/first values (partial aggregation)
# ---------------------------------------------------------------------------

def last_user_prompt(msgs: DataFrame) -> DataFrame:
    """Last user message with non-empty content, else ''."""
    cond = (F.col("role") == "user") & (F.coalesce(F.col("content"), F.lit("")) != "")
    return msgs.groupBy(RUN).agg(
        F.coalesce(F.max_by(F.when(cond, F.col("content")), F.when(cond, F.col("pos"))), F.lit("")).alias("prompt"))


def current_run(chunks: DataFrame, session: Column) -> DataFrame:
    """Per client session, the run of the last chunk (client) and of the first (smoke script); ties go by seq."""
    c = chunks.where(F.coalesce(F.col(RUN), F.lit("")) != "").withColumn("session", session)
    at = F.struct("timestamp", "seq", RUN)
    return c.groupBy("session").agg(F.max_by(RUN, at).alias("current_run"), F.min_by(RUN, at).alias("first_run"))


def run_of_message(chunks: DataFrame, session: Column, message_id: Column) -> DataFrame:
    """Each assistant message is bound to the run current when it is first seen, never rebound; ties go by seq."""
    c = chunks.where(F.col("type") == "content").withColumn("message_id", message_id).withColumn("session", session)
    return c.groupBy("session", "message_id").agg(F.min_by(RUN, F.struct("timestamp", "seq", RUN)).alias("bound_run"),
                                                  F.min("timestamp").alias("first_seen_ms"))


def first_chunk(chunks: DataFrame, type_: str, tool: str | None = None) -> DataFrame:
    """First chunk of a kind (and tool) per run."""
    c = chunks.where(F.col("type") == type_)
    if tool is not None:
        c = c.where(F.col("tool_name") == tool)
    return c.groupBy(RUN).agg(F.min_by(F.struct("seq", "tool_call_id", "tool_name", "arguments", "input"), "seq")
                              .alias("first")).select(RUN, "first.*")


def envelope_artifacts(chunks: DataFrame) -> DataFrame:
    """Artifact ids in tool results, one row each: (run, seq, pos, artifact_id)."""
    r = chunks.where(F.col("type") == "tool_result").select(RUN, "seq", parse_envelope(F.col("content")).alias("env"))
    return r.select(RUN, "seq", F.posexplode(F.col("env.artifacts")).alias("pos", "a")) \
            .select(RUN, "seq", "pos", F.col("a.id").alias("artifact_id"))


def distinct_artifacts(chunks: DataFrame) -> DataFrame:
    """W12 + U3: artifact ids of a run in first-seen order (ordinal 1, 2, ...), de-duplicated."""
    a = envelope_artifacts(chunks)
    first = a.groupBy(RUN, "artifact_id").agg(F.min(F.struct("seq", "pos")).alias("f")) \
             .select(RUN, "artifact_id", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos"))
    return running_index(first, [RUN], ["first_seq", "first_pos"], _bucket("first_seq"), "ordinal", base=1)


def first_artifact(chunks: DataFrame) -> DataFrame:
    """The first artifact id of a run."""
    a = envelope_artifacts(chunks)
    return a.groupBy(RUN).agg(F.min_by("artifact_id", F.struct("seq", "pos")).alias("artifact_id"))


def run_state_summary(updates: DataFrame, slice_cols: list[str]) -> DataFrame:
    """W10 over each slice (run, *slice_cols) of the writes, keeping every field's seq so slices fold again.

    One row per slice: the slice's last clear, and for the writes after it the
    latest messages / pending / model with their seqs, first/last write time and
    count.  The slice's clear comes from a window per slice (bounded by the
    slice), and the aggregate reuses that partitioning.
    """
    keys = [RUN, *slice_cols]
    is_clear = F.col("kind") == "clear"
    w = updates.withColumn("__clear", F.max(F.when(is_clear, F.col("seq"))).over(Window.partitionBy(*keys)))
    live = (F.col("__clear").isNull() | (F.col("seq") > F.col("__clear"))) & ~is_clear
    is_msg = live & (F.col("kind") == "set_messages")
    is_pend = live & (F.col("kind") == "set_pending")
    has_model = live & F.col("model").isNotNull()
    return w.groupBy(*keys).agg(
        F.max("__clear").alias("clear_seq"),
        F.max(F.when(is_msg, F.col("seq"))).alias("msg_seq"),
        F.max_by(F.when(is_msg, F.col("messages")), F.when(is_msg, F.col("seq"))).alias("messages"),
        F.max(F.when(is_pend, F.col("seq"))).alias("pend_seq"),
        F.max_by(F.when(is_pend, F.col("pending")), F.when(is_pend, F.col("seq"))).alias("pending"),
        F.max(F.when(has_model, F.col("seq"))).alias("model_seq"),
        F.max_by(F.when(has_model, F.col("model")), F.when(has_model, F.col("seq"))).alias("model"),
        F.min(F.when(live, F.col("written_at"))).alias("created_at"),
        F.max(F.when(live, F.col("written_at"))).alias("updated_at"),
        F.count_if(live).alias("n_writes"))


def merge_run_state_summaries(summaries: DataFrame, order: Column) -> DataFrame:
    """Slice summaries of a run folded into one that can be folded again; ``order`` must follow seq order across slices.

    Slices before the one holding a run's latest clear are dropped, the rest
    fold by per-field seq.  The join on run_id sees one row per slice. The
    merged row stands in the place (``slice``) of the run's last one.
    """
    s = summaries.withColumn("__order", order)
    last_clear = s.groupBy(RUN).agg(F.max(F.when(F.col("clear_seq").isNotNull(), F.col("__order"))).alias("__co"))
    keep = s.join(last_clear, RUN).where(F.col("__co").isNull() | (F.col("__order") >= F.col("__co")))
    last_slice = [F.max("slice").alias("slice")] if "slice" in summaries.columns else []
    return keep.groupBy(RUN).agg(
        *last_slice, F.max("clear_seq").alias("clear_seq"),
        F.max("msg_seq").alias("msg_seq"), F.max_by("messages", "msg_seq").alias("messages"),
        F.max("pend_seq").alias("pend_seq"), F.max_by("pending", "pend_seq").alias("pending"),
        F.max("model_seq").alias("model_seq"), F.max_by("model", "model_seq").alias("model"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.sum("n_writes").alias("n_writes"))


def fold_run_state_summaries(summaries: DataFrame, order: Column) -> DataFrame:
    """Current run state from slice summaries (``merge_run_state_summaries``); cleared runs have none."""
    return merge_run_state_summaries(summaries, order).where(F.col("n_writes") > 0).select(
        RUN, "messages", "pending", "model", "created_at", "updated_at", "n_writes")


def fold_run_state(updates: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """Run-store writes folded into the current state per run.

    Rows after the run's last ``clear`` count (a run whose last write is a clear
    has no state).  messages / pending are the latest of their own writes — an
    explicit NULL pending wins — and model is the latest non-NULL one.
    Computed as summaries per (run, seq bucket) folded again per run, so no task
    ever holds all writes of one run.
    """
    sliced = updates.withColumn("__slice", F.floor(F.col("seq") / F.lit(bucket_width)))
    return fold_run_state_summaries(run_state_summary(sliced, ["__slice"]), F.col("__slice"))


def usage_by_run(chunks: DataFrame) -> DataFrame:
    """Usage of the run's last done chunk (what the final done reports) and the sum over segments."""
    d = chunks.where(F.col("type") == "done").withColumn("u", usage_struct(F.col("usage")))
    return d.groupBy(RUN).agg(
        F.max_by("u", "seq").alias("last"),
        F.sum("u.promptTokens").alias("sum_prompt_tokens"),
        F.sum("u.completionTokens").alias("sum_completion_tokens"),
        F.sum("u.totalTokens").alias("sum_total_tokens"),
        F.count(F.lit(1)).alias("n_segments"),
    ).select(RUN, F.col("last.promptTokens").alias("prompt_tokens"),
             F.col("last.completionTokens").alias("completion_tokens"),
             F.col("last.totalTokens").alias("total_tokens"),
             "sum_prompt_tokens", "sum_completion_tokens", "sum_total_tokens", "n_segments")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Per run, chunk counts by kind, tool calls/approvals, first error and the last content delta.

    Bounded-size aggregates only (no per-run list), so a hot run is combined map-side.
    """
    t = F.col("type")
    return chunks.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(t == "content").alias("n_content"),
        F.count_if(t == "thinking").alias("n_thinking"),
        F.count_if(t == "tool_call").alias("n_tool_calls"),
        F.count_if(t == "approval-requested").alias("n_approval_requests"),
        F.count_if(t == "tool-input-available").alias("n_client_calls"),
        F.count_if(t == "tool_result").alias("n_tool_results"),
        F.count_if(t == "done").alias("n_done"),
        F.count_if(t == "error").alias("n_errors"),
        F.min_by(F.when(t == "error", F.col("error_message")), F.when(t == "error", F.col("seq"))).alias("first_error"),
        F.max_by(F.when(t == "content", F.col("delta")), F.when(t == "content", F.col("seq"))).alias("last_delta"),
        F.min_by(F.when(t.isin("tool_call", "approval-requested"), F.col("tool_name")),
                 F.when(t.isin("tool_call", "approval-requested"), F.col("seq"))).alias("first_tool"),
        F.max("seq").alias("last_seq"))


def last_content(chunks: DataFrame) -> DataFrame:
    """The run's last accumulated content (the finished text of its last content part)."""
    parts = accumulate_text(chunks, "content", final_only=True)
    return parts.groupBy(RUN).agg(F.max_by("content", "last_seq").alias("last_content"),
                                  F.max("last_seq").alias("last_content_seq"))


def tool_sequence(chunks: DataFrame) -> DataFrame:
    """N4 (long form): the ordered tool names of a run from tool_call and approval-requested chunks."""
    c = chunks.where(F.col("type").isin("tool_call", "approval-requested")).select(RUN, "seq", "type", "tool_name")
    return running_index(c, [RUN], ["seq"], _bucket(), "ordinal", base=1)


def chunk_types(chunks: DataFrame) -> DataFrame:
    """N4 (long form): the kinds of a run's chunks in the order in which they first come, with their counts."""
    first = chunks.groupBy(RUN, "type").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_chunks"))
    return running_index(first, [RUN], ["first_seq", "type"], _bucket("first_seq"), "ordinal", base=1)


def error_texts(chunks: DataFrame) -> DataFrame:
    """N4 (long form): every error text of a run, in order."""
    e = chunks.where(F.col("type") == "error").select(RUN, "seq", "error_message")
    return running_index(e, [RUN], ["seq"], _bucket(), "ordinal", base=1)


# ---------------------------------------------------------------------------
# Joins on (run_id, tool_call_id)
# ---------------------------------------------------------------------------

def _latest_requests(chunks: DataFrame, type_: str) -> DataFrame:
    r = chunks.where(F.col("type") == type_)
    return r.groupBy(RUN, "tool_call_id").agg(
        F.max("seq").alias("seq"),
        F.max_by("tool_name", "seq").alias("tool_name"),
        F.max_by("input", "seq").alias("input"))


def pending_approvals(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approval requests with no later tool_result and no later decision (latest request per id)."""
    req = _latest_requests(chunks, "approval-requested")
    results = chunks.where(F.col("type") == "tool_result").select(RUN, "tool_call_id", F.col("seq").alias("rseq"))
    dec = decisions.select(RUN, "tool_call_id", F.col("seq").alias("rseq"))
    resolved = results.unionByName(dec)
    cond = ((req[RUN] == resolved[RUN]) & (req["tool_call_id"] == resolved["tool_call_id"])
            & (resolved["rseq"] > req["seq"]))
    return req.join(resolved, cond, "left_anti").select(RUN, "tool_call_id", "tool_name", "seq")


def approval_queue(pending: DataFrame) -> DataFrame:
    """Per run, the oldest pending request and how many wait behind it."""
    return pending.groupBy(RUN).agg(F.min_by("tool_call_id", "seq").alias("first_tool_call_id"),
                                    (F.count(F.lit(1)) - 1).alias("n_behind"))


def call_result_pairs(chunks: DataFrame) -> DataFrame:
    """Every tool call with its result(s) (left join; unanswered calls keep NULLs)."""
    calls = chunks.where(F.col("type") == "tool_call").select(RUN, "tool_call_id", "tool_name",
                                                              F.col("seq").alias("call_seq"))
    res = chunks.where(F.col("type") == "tool_result").select(RUN, "tool_call_id", F.col("seq").alias("result_seq"),
                                                              F.length("content").alias("result_chars"),
                                                              log_preview(F.col("content")).alias("result_preview"))
    return calls.join(res, [RUN, "tool_call_id"], "left")


def pending_client_calls(chunks: DataFrame, msgs: DataFrame, message_pos: Column) -> DataFrame:
    """Latest tool-input-available per run, unless its result was posted later or a later user message came.

    ``message_pos`` says, of a chunk, the position (``msgs.pos``) of the message it answers.
    """
    chunks = chunks.withColumn("__pos", message_pos)
    req = chunks.where(F.col("type") == "tool-input-available").groupBy(RUN).agg(
        F.max_by(F.struct("seq", "tool_call_id", "tool_name", "input", "__pos"), "seq").alias("r")).select(RUN, "r.*")
    results = chunks.where(F.col("type") == "tool_result").select(RUN, "tool_call_id", F.col("seq").alias("rseq"))
    users = msgs.where(F.col("role") == "user").groupBy(RUN).agg(F.max("pos").alias("last_user_pos"))
    answered = ((req[RUN] == results[RUN]) & (req["tool_call_id"] == results["tool_call_id"])
                & (results["rseq"] > req["seq"]))
    open_ = req.join(results, answered, "left_anti")
    return (open_.join(users, RUN, "left")
            .where(F.col("last_user_pos").isNull() | (F.col("last_user_pos") <= F.col("__pos")))
            .select(RUN, "tool_call_id", "tool_name", "input", "seq"))


def resume_keys(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each run waits for and what has come, one row per (run, tool call, kind), from one aggregate.

    Expected: approval ids (approval-requested) and result ids (tool-input-available). Collected: decisions and
    tool results, the last value of each key (an explicit NULL included). Every run keeps a row of kind NULL, so
    the runs need no second pass.
    """
    t = F.col("type")
    kind = (F.when(t == "approval-requested", "approval").when(t.isin("tool-input-available", "tool_result"), "result"))
    came = t == "tool_result"
    seen = chunks.select(
        RUN, F.when(kind.isNotNull(), F.col("tool_call_id")).alias("tool_call_id"), kind.alias("kind"),
        (kind.isNotNull() & ~came).alias("expected"), came.alias("collected"),
        F.when(came, F.col("content")).alias("value"), F.when(came, F.col("seq")).alias("seq"))
    decided = decisions.select(RUN, "tool_call_id", F.lit("approval").alias("kind"), F.lit(False).alias("expected"),
                               F.lit(True).alias("collected"), "value", "seq")
    return seen.unionByName(decided).groupBy(RUN, "tool_call_id", "kind").agg(
        F.bool_or("expected").alias("is_expected"), F.bool_or("collected").alias("present"),
        F.max_by(F.when(F.col("collected"), F.col("value")), F.when(F.col("collected"), F.col("seq"))).alias("value"),
        F.bool_or(~F.col("collected") | (F.col("kind") != "approval")).alias("in_chunks"))


def collected_values(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """The values a resuming run takes up, one row per expected key that has come."""
    return resume_keys(chunks, decisions).where("is_expected AND present").select(RUN, "kind", "tool_call_id", "value")


def ready_runs(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """J3 + U1: may a run resume?

    Ready when both expected sets are covered; with nothing expected, any payload resumes the run. Only expected
    keys are counted (``resume_keys``); a second aggregate per run follows. Runs that have only decisions are left out.
    """
    approved = F.coalesce(normalize_approval(F.col("value")).getField("approved"), F.lit(False))
    exp_ = F.col("is_expected")
    is_a = F.col("kind") == "approval"
    per_run = resume_keys(chunks, decisions).groupBy(RUN).agg(
        F.count_if(exp_ & is_a).alias("n_expected_approvals"),
        F.count_if(exp_ & ~is_a).alias("n_expected_results"),
        F.count_if(exp_ & ~F.col("present")).alias("n_missing"),
        F.count_if(exp_ & is_a & F.col("present") & approved).alias("n_approved"),
        F.bool_or("present").alias("__payload"), F.bool_or("in_chunks").alias("__run"))
    n_exp = F.col("n_expected_approvals") + F.col("n_expected_results")
    return per_run.where("__run").select(
        RUN, "n_expected_approvals", "n_expected_results", "n_missing", "n_approved",
        F.when(n_exp == 0, F.col("__payload")).otherwise(F.col("n_missing") == 0).alias("ready"))


# ---------------------------------------------------------------------------
# Stream shape
# ---------------------------------------------------------------------------

def idle_gaps(chunks: DataFrame, seconds: int = KEEPALIVE_SECONDS) -> DataFrame:
    """T5: gaps longer than ``seconds`` between consecutive chunks of a run, and the keep-alives they cost.

    The previous chunk comes from a bucketed lag (``sequence.lag_in_order``), not a per-run window.
    """
    c = chunks.select(RUN, "seq", "timestamp")
    pairs = lag_in_order(c, [RUN], "seq", _bucket(), ["timestamp", "seq"])
    gap = F.col("timestamp") - F.col("prev_timestamp")
    return (pairs.where(gap > seconds * 1000)
            .select(RUN, "seq", F.col("prev_seq"), gap.alias("gap_ms"),
                    F.floor(gap / F.lit(seconds * 1000)).alias("n_keepalives")))


def split_segments(chunks: DataFrame) -> DataFrame:
    """Segment number of each chunk (dones before it) and whether the client sees it.

    done chunks that close a deferred segment (finish tool_calls) are hidden.
    """
    c = chunks.select(RUN, "seq", "type", "finish_reason")
    is_done = (F.col("type") == "done").cast("long")
    seg = running_sum(c, [RUN], ["seq"], is_done, _bucket(), "segment", inclusive=False)
    visible = ~((F.col("type") == "done") & (finish_reason(F.col("finish_reason")) == "tool_calls"))
    return seg.select(RUN, "seq", "type", "segment", visible.alias("visible"))


def deferred_to_chunks(msgs: DataFrame) -> DataFrame:
    """T7 + U2: deferred requests of each segment as chunks: approvals first, then client calls, each in call order.

    A user turn is one deferred segment; execute_sql needs approval, export_csv runs on the client. A message holds its
    calls as an array ``calls`` of (call_id, call_tool), in the order in which they were made; a table with one
    ``call_id`` and ``call_tool`` a row has that one call. Finish reason of the segment is tool_calls when anything was
    deferred, else stop.
    """
    given = F.col("calls") if "calls" in msgs.columns else F.array(F.struct("call_id", "call_tool"))
    calls = F.coalesce(given, F.array().cast("array<struct<call_id: string, call_tool: string>>"))
    seg = msgs.where(F.col("role") == "user").select(
        RUN, F.col("pos").alias("segment"), F.filter(calls, lambda c: c["call_tool"] == "execute_sql").alias("approvals"),
        F.filter(calls, lambda c: c["call_tool"] != "execute_sql").alias("calls"))
    a = seg.select(RUN, "segment", F.posexplode("approvals").alias("ord", "p")) \
           .select(RUN, "segment", F.lit(0).alias("group"), "ord", F.lit("approval-requested").alias("type"),
                   F.col("p.call_id").alias("tool_call_id"), F.col("p.call_tool").alias("tool_name"),
                   F.col("p.call_id").alias("approval_id"))
    c = seg.select(RUN, "segment", F.posexplode("calls").alias("ord", "p")) \
           .select(RUN, "segment", F.lit(1).alias("group"), "ord", F.lit("tool-input-available").alias("type"),
                   F.col("p.call_id").alias("tool_call_id"), F.col("p.call_tool").alias("tool_name"),
                   F.lit(None).cast("string").alias("approval_id"))
    fin = seg.select(RUN, "segment", F.lit(2).alias("group"), F.lit(0).alias("ord"), F.lit("done").alias("type"),
                     F.lit(None).cast("string").alias("tool_call_id"),
                     F.when(F.size("approvals") + F.size("calls") > 0, F.lit("tool_calls"))
                     .otherwise(F.lit("stop")).alias("tool_name"),
                     F.lit(None).cast("string").alias("approval_id"))
    return a.unionByName(c).unionByName(fin).withColumnRenamed("tool_name", "tool_name_or_finish")


def close_failed_runs(chunks: DataFrame) -> DataFrame:
    """For a run whose error is not followed by a done, the closing done(stop) row to append."""
    s = chunks.groupBy(RUN).agg(F.max(F.when(F.col("type") == "error", F.col("seq"))).alias("error_seq"),
                                F.max(F.when(F.col("type") == "done", F.col("seq"))).alias("done_seq"),
                                F.max("seq").alias("last_seq"))
    need = s.where(F.col("error_seq").isNotNull() & (F.col("done_seq").isNull() | (F.col("done_seq") < F.col("error_seq"))))
    return need.select(RUN, (F.col("last_seq") + 1).alias("seq"), F.lit("done").alias("type"),
                       F.lit("stop").alias("finish_reason"))


def closed_stream(chunks: DataFrame) -> DataFrame:
    """The chunk stream with the missing closing done rows (model and time of the run's last chunk)."""
    last = chunks.groupBy(RUN).agg(F.max_by(F.struct("model", "timestamp"), "seq").alias("l"))
    closing = close_failed_runs(chunks).join(last, RUN).select(RUN, "seq", "type", "finish_reason", "l.model", "l.timestamp")
    return chunks.unionByName(closing, allowMissingColumns=True)


def check_streams(chunks: DataFrame) -> DataFrame:
    """Per-run quality report: has done, has an approval request, a valid envelope, an artifact."""
    is_res = F.col("type") == "tool_result"
    # the envelope is parsed once, and of results only
    seen = chunks.select(RUN, "type", is_res.alias("is_res"), F.when(is_res, parse_envelope(F.col("content"))).alias("env"))
    valid, result = F.col("env").isNotNull(), F.col("is_res")
    return seen.groupBy(RUN).agg(
        F.bool_or(F.col("type") == "done").alias("has_done"),
        F.bool_or(F.col("type") == "approval-requested").alias("has_approval"),
        F.coalesce(F.bool_or(result & valid), F.lit(False)).alias("has_valid_envelope"),
        F.coalesce(F.bool_or(result & (F.coalesce(F.size("env.artifacts"), F.lit(0)) > 0)), F.lit(False)).alias("has_artifact"),
        F.count_if(result & ~valid).alias("n_invalid_results"))
