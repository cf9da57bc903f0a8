"""Registered run-event queries (W, J, N3, N4, T5-T9, F) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import approvals as FA
from ..functions import envelopes as FE
from ..functions import usage as FU
from ..operators import runs as RU
from ..schemas import KEEPALIVE_SECONDS
from ..sources import derive
from ..sources.derive import TURN_STRIDE as K
from ..streaming import streams as ST
from .oracle_views import with_views
from .registry import register

CHUNK_COLS = ["run_id", "seq", "type", "model", "timestamp", "part_index", "is_start", "delta", "role",
              "tool_call_id", "tool_name", "arguments", "input", "content", "error_message", "finish_reason", "usage"]


def _chunks(spark, sf):
    return derive.chunks(spark, sf)


def _msgs(spark, sf):
    return derive.messages(spark, sf)


def _dec(spark, sf):
    return derive.approvals(spark, sf)


def V(names, body):
    return with_views(names, body)


# --- SQL fragments shared by twins -----------------------------------------

def _num(expr_json: str, names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(json_extract_string({expr_json}, '$.{n}') AS BIGINT)" for n in names) + ")"


_P = _num("usage", ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"])
_C = _num("usage", ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"])
_T = _num("usage", ["total_tokens", "totalTokens"])

# envelope validity over j = content if it is valid JSON, else NULL
_ARTS = ("list_filter(CASE WHEN json_type(j, '$.artifacts') = 'ARRAY' THEN json_extract(j, '$.artifacts[*]') END, "
         "lambda x: coalesce(json_type(x, '$.id') = 'VARCHAR', false))")
_ENV_OK = f"""(coalesce(json_type(j) = 'OBJECT', false)
  AND coalesce(json_type(j, '$.type') = 'VARCHAR' AND json_extract_string(j, '$.type') = 'tool_result', false)
  AND coalesce(json_type(j, '$.version') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'INTEGER')
               AND CAST(json_extract(j, '$.version') AS DOUBLE) = 1, false)
  AND (coalesce(json_type(j, '$.message') = 'VARCHAR' AND json_extract_string(j, '$.message') <> '', false)
       OR coalesce(len({_ARTS}) > 0, false)
       OR coalesce(json_type(j, '$.data') = 'OBJECT', false)))"""
_ENV_ROWS = f"""env AS (
  SELECT run_id, seq, j, {_ENV_OK} AS ok, {_ARTS} AS arts
  FROM (SELECT run_id, seq, CASE WHEN json_valid(content) THEN content END AS j FROM chunks WHERE type = 'tool_result'))"""
_ART_ROWS = """arts AS (
  SELECT run_id, seq, unnest(generate_series(0, len(arts) - 1)) AS pos,
         json_extract_string(unnest(arts), '$.id') AS artifact_id
  FROM env WHERE ok)"""
_APPROVED = """CASE WHEN trim(value) IN ('true', 'false') THEN trim(value) = 'true'
     WHEN json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT'
          AND json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.kind') = 'tool-approved' THEN true
     ELSE false END"""


# --- T1 batch twin: the typed chunk log -------------------------------------

@register("chunks_log", V(["chunks"], f"SELECT {', '.join(CHUNK_COLS)} FROM chunks"))
def chunks_log(spark, sf):
    """T1 (batch): the run event log typed by kind (whole texts, one row per word)."""
    return _chunks(spark, sf).select(*CHUNK_COLS)


# --- W1 / W2 ----------------------------------------------------------------

def _acc_sql(kind: str, extra: str = "") -> str:
    return f"""
SELECT run_id, part_index, segment, seq, delta,
       array_to_string(list(delta ORDER BY seq) OVER (PARTITION BY run_id, part_index, segment ORDER BY seq
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS content
FROM (SELECT *, CAST(sum(CAST(is_start AS BIGINT)) OVER (PARTITION BY run_id, part_index ORDER BY seq
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment
      FROM chunks WHERE type = '{kind}' {extra})
QUALIFY NOT (is_start AND coalesce(delta, '') = '')"""


@register("w1_accumulate_text", V(["chunks"], _acc_sql("content")))
def w1(spark, sf):
    """Running assistant text per part (start resets; empty start emits nothing)."""
    return RU.accumulate_text(_chunks(spark, sf), "content")


@register("w2_accumulate_thinking", V(["chunks"], _acc_sql("thinking", "AND (is_start OR coalesce(delta, '') <> '')")))
def w2(spark, sf):
    """Running thinking text (empty deltas skipped)."""
    return RU.accumulate_text(_chunks(spark, sf), "thinking")


@register("w1_final_text", V(["chunks"], """
SELECT run_id, part_index, segment, string_agg(delta, '' ORDER BY seq) AS content, max(seq) AS last_seq,
       count(*) AS n_deltas
FROM (SELECT *, CAST(sum(CAST(is_start AS BIGINT)) OVER (PARTITION BY run_id, part_index ORDER BY seq
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment
      FROM chunks WHERE type = 'content')
GROUP BY run_id, part_index, segment"""))
def w1_final(spark, sf):
    """W1 with final_only=True: the finished text of every part."""
    return RU.accumulate_text(_chunks(spark, sf), "content", final_only=True)


# --- W3, W6-W12 ---------------------------------------------------------------

@register("w3_index_tool_calls", V(["chunks"], """
SELECT run_id, seq, tool_call_id, tool_name, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS index
FROM chunks WHERE type = 'tool_call'"""))
def w3(spark, sf):
    """Running tool-call index over the whole run."""
    return RU.index_tool_calls(_chunks(spark, sf))


@register("w6_order_tool_returns", V(["messages"], """
WITH calls AS (SELECT run_id, call_id AS return_id, min(pos) AS call_pos FROM messages
               WHERE call_id IS NOT NULL GROUP BY 1, 2),
keyed AS (
  SELECT run_id, pos, pos AS k1, 0 AS k2 FROM messages WHERE return_id IS NULL
  UNION ALL
  SELECT m.run_id, m.pos, coalesce(c.call_pos, 4611686018427387904) AS k1, 1 AS k2
  FROM messages m LEFT JOIN calls c ON m.run_id = c.run_id AND m.return_id = c.return_id
  WHERE m.return_id IS NOT NULL)
SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY k1, k2, pos) - 1 AS new_pos FROM keyed"""))
def w6(spark, sf):
    """Tool returns moved right behind their calls; orphans last."""
    return RU.order_tool_returns(_msgs(spark, sf))


@register("w6_call_arrays", V(["call_arrays"], """
WITH calls AS (
  SELECT run_id, id AS return_id, min({'pos': pos, 'ord': ord}) AS c
  FROM (SELECT run_id, pos, unnest(call_ids) AS id, unnest([0, 1, 2]) AS ord FROM call_arrays WHERE call_ids IS NOT NULL) GROUP BY 1, 2),
keyed AS (
  SELECT m.run_id, m.pos, CASE WHEN m.return_id IS NULL THEN m.pos ELSE coalesce(c.c.pos, 4611686018427387904 + m.pos) END AS k1,
         CASE WHEN m.return_id IS NULL THEN 0 ELSE 1 END AS k2, coalesce(c.c.ord, 0) AS k3
  FROM call_arrays m LEFT JOIN calls c ON m.run_id = c.run_id AND m.return_id = c.return_id)
SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY k1, k2, k3, pos) - 1 AS new_pos FROM keyed"""))
def w6_arrays(spark, sf):
    """W6 with three calls a message and their returns in another order: returns follow in the order of the calls."""
    return RU.order_tool_returns(derive.call_arrays(spark, sf))


@register("w7_last_user_prompt", V(["messages"], """
SELECT run_id, coalesce(arg_max(content, pos) FILTER (WHERE role = 'user' AND coalesce(content, '') <> ''), '') AS prompt
FROM messages GROUP BY run_id"""))
def w7(spark, sf):
    """Last non-empty user prompt per run."""
    return RU.last_user_prompt(_msgs(spark, sf))


@register("w8_run_of_message", V(["chunks"], f"""
SELECT CAST(substring(run_id, 5, 64) AS BIGINT) % 50 AS session, run_id || ':' || CAST(seq // {K} AS VARCHAR) AS message_id,
       arg_min(run_id, (timestamp, seq, run_id)) AS bound_run, min(timestamp) AS first_seen_ms
FROM chunks WHERE type = 'content' GROUP BY 1, 2"""))
def w8(spark, sf):
    """The run an assistant message is bound to when first seen."""
    return RU.run_of_message(_chunks(spark, sf), derive.session_of(F.col("run_id")),
                             derive.message_of(F.col("run_id"), F.col("seq")))


@register("w9_current_run", V(["chunks"], """
SELECT CAST(substring(run_id, 5, 64) AS BIGINT) % 50 AS session, arg_max(run_id, (timestamp, seq, run_id)) AS current_run,
       arg_min(run_id, (timestamp, seq, run_id)) AS first_run
FROM chunks WHERE coalesce(run_id, '') <> '' GROUP BY 1"""))
def w9(spark, sf):
    """Current (last) and first run per client session."""
    return RU.current_run(_chunks(spark, sf), derive.session_of(F.col("run_id")))


@register("w10_fold_run_state", V(["run_updates"], """
WITH lc AS (SELECT run_id, max(CASE WHEN kind = 'clear' THEN seq END) AS clear_seq FROM run_updates GROUP BY run_id),
live AS (SELECT u.* FROM run_updates u JOIN lc USING (run_id)
         WHERE (clear_seq IS NULL OR seq > clear_seq) AND kind <> 'clear')
SELECT run_id,
       arg_max_null(messages, seq) FILTER (WHERE kind = 'set_messages') AS messages,
       arg_max_null(pending, seq) FILTER (WHERE kind = 'set_pending') AS pending,
       arg_max(model, seq) FILTER (WHERE model IS NOT NULL) AS model,
       min(written_at) AS created_at, max(written_at) AS updated_at, count(*) AS n_writes
FROM live GROUP BY run_id"""))
def w10(spark, sf):
    """Run-store writes folded into current state (clear, NULL-able pending, sticky model)."""
    return RU.fold_run_state(derive.run_updates(spark, sf))


@register("w11_first_sql_call", V(["chunks"], """
SELECT run_id, min(seq) AS seq, arg_min(tool_call_id, seq) AS tool_call_id, arg_min(tool_name, seq) AS tool_name,
       arg_min(arguments, seq) AS arguments, arg_min(input, seq) AS input
FROM chunks WHERE type = 'tool_call' AND tool_name = 'execute_sql' GROUP BY run_id"""))
def w11(spark, sf):
    """First execute_sql tool call per run."""
    return RU.first_chunk(_chunks(spark, sf), "tool_call", "execute_sql")


@register("w12_distinct_artifacts", V(["chunks"], f"""
WITH {_ENV_ROWS}, {_ART_ROWS},
firsts AS (SELECT run_id, artifact_id, min({{'s': seq, 'p': pos}}) AS f FROM arts GROUP BY 1, 2)
SELECT run_id, artifact_id, f.s AS first_seq, CAST(f.p AS INTEGER) AS first_pos,
       row_number() OVER (PARTITION BY run_id ORDER BY f.s, f.p) AS ordinal
FROM firsts"""))
def w12(spark, sf):
    """W12 + U3: artifact ids per run in first-seen order, de-duplicated."""
    return RU.distinct_artifacts(_chunks(spark, sf))


@register("w12_first_artifact", V(["chunks"], f"""
WITH {_ENV_ROWS}, {_ART_ROWS}
SELECT run_id, arg_min(artifact_id, seq * 1000000 + pos) AS artifact_id FROM arts GROUP BY run_id"""))
def w12_first(spark, sf):
    """First artifact id per run."""
    return RU.first_artifact(_chunks(spark, sf))


# --- N3, N4 -----------------------------------------------------------------

@register("n3_usage_by_run", V(["chunks"], f"""
WITH d AS (SELECT run_id, seq, {_P} AS p, {_C} AS c, {_T} AS t FROM chunks WHERE type = 'done'),
n AS (SELECT run_id, seq, CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN p END AS pp,
             CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN c END AS cc,
             CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN coalesce(t, p + c) END AS tt FROM d)
SELECT run_id, arg_max_null(pp, seq) AS prompt_tokens, arg_max_null(cc, seq) AS completion_tokens,
       arg_max_null(tt, seq) AS total_tokens, CAST(sum(pp) AS BIGINT) AS sum_prompt_tokens, CAST(sum(cc) AS BIGINT) AS sum_completion_tokens,
       CAST(sum(tt) AS BIGINT) AS sum_total_tokens, count(*) AS n_segments
FROM n GROUP BY run_id"""))
def n3(spark, sf):
    """Usage reported on the final done (last segment) and summed over segments."""
    return RU.usage_by_run(_chunks(spark, sf))


@register("n4_chunk_summary", V(["chunks"], """
SELECT run_id, count(*) AS n_chunks,
       count(*) FILTER (WHERE type = 'content') AS n_content, count(*) FILTER (WHERE type = 'thinking') AS n_thinking,
       count(*) FILTER (WHERE type = 'tool_call') AS n_tool_calls,
       count(*) FILTER (WHERE type = 'approval-requested') AS n_approval_requests,
       count(*) FILTER (WHERE type = 'tool-input-available') AS n_client_calls,
       count(*) FILTER (WHERE type = 'tool_result') AS n_tool_results,
       count(*) FILTER (WHERE type = 'done') AS n_done, count(*) FILTER (WHERE type = 'error') AS n_errors,
       arg_min(error_message, seq) FILTER (WHERE type = 'error') AS first_error,
       arg_max(delta, seq) FILTER (WHERE type = 'content') AS last_delta,
       arg_min(tool_name, seq) FILTER (WHERE type IN ('tool_call', 'approval-requested')) AS first_tool,
       max(seq) AS last_seq
FROM chunks GROUP BY run_id"""))
def n4(spark, sf):
    """Per-run chunk summary."""
    return RU.chunk_summary(_chunks(spark, sf))


@register("n4_last_content", V(["chunks"], """
WITH seg AS (
  SELECT run_id, part_index, segment, string_agg(delta, '' ORDER BY seq) AS content, max(seq) AS last_seq
  FROM (SELECT *, CAST(sum(CAST(is_start AS BIGINT)) OVER (PARTITION BY run_id, part_index ORDER BY seq
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment
        FROM chunks WHERE type = 'content')
  GROUP BY run_id, part_index, segment)
SELECT run_id, arg_max(content, last_seq) AS last_content, max(last_seq) AS last_content_seq FROM seg GROUP BY run_id"""))
def n4_last(spark, sf):
    """Last accumulated content per run."""
    return RU.last_content(_chunks(spark, sf))


@register("n4_tool_sequence", V(["chunks"], """
SELECT run_id, seq, type, tool_name, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS ordinal
FROM chunks WHERE type IN ('tool_call', 'approval-requested')"""))
def n4_seq(spark, sf):
    """N4 (long form): ordered tool names per run."""
    return RU.tool_sequence(_chunks(spark, sf))


@register("n4_chunk_types", V(["chunks"], """
SELECT run_id, type, first_seq, n_chunks, row_number() OVER (PARTITION BY run_id ORDER BY first_seq, type) AS ordinal
FROM (SELECT run_id, type, min(seq) AS first_seq, count(*) AS n_chunks FROM chunks GROUP BY run_id, type)"""))
def n4_types(spark, sf):
    """N4 (long form): ordered chunk kinds per run."""
    return RU.chunk_types(_chunks(spark, sf))


@register("n4_error_texts", V(["chunks"], """
SELECT run_id, seq, error_message, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS ordinal
FROM chunks WHERE type = 'error'"""))
def n4_errors(spark, sf):
    """N4 (long form): every error text per run, in order."""
    return RU.error_texts(_chunks(spark, sf))


# --- J2, J3, J6, J8, J9 ---------------------------------------------------------

_PENDING = """
req AS (SELECT run_id, tool_call_id, max(seq) AS seq, arg_max(tool_name, seq) AS tool_name
        FROM chunks WHERE type = 'approval-requested' GROUP BY 1, 2),
res AS (SELECT run_id, tool_call_id, seq AS rseq FROM chunks WHERE type = 'tool_result'
        UNION ALL SELECT run_id, tool_call_id, seq FROM approvals),
pending AS (SELECT run_id, tool_call_id, tool_name, seq FROM req r
            WHERE NOT EXISTS (SELECT 1 FROM res x WHERE x.run_id = r.run_id AND x.tool_call_id = r.tool_call_id
                                                     AND x.rseq > r.seq))"""


@register("j2_pending_approvals", V(["chunks", "approvals"], f"WITH {_PENDING} SELECT * FROM pending"))
def j2(spark, sf):
    """Approval requests still waiting (no later result, no later decision)."""
    return RU.pending_approvals(_chunks(spark, sf), _dec(spark, sf))


@register("j9_approval_queue", V(["chunks", "approvals"], f"""
WITH {_PENDING}
SELECT run_id, arg_min(tool_call_id, seq) AS first_tool_call_id, count(*) - 1 AS n_behind FROM pending GROUP BY run_id"""))
def j9(spark, sf):
    """Oldest pending approval per run and how many wait behind it."""
    return RU.approval_queue(RU.pending_approvals(_chunks(spark, sf), _dec(spark, sf)))


@register("j6_call_result_pairs", V(["chunks"], """
SELECT c.run_id, c.tool_call_id, c.tool_name, c.seq AS call_seq, r.seq AS result_seq, CAST(length(r.content) AS INTEGER) AS result_chars,
       CASE WHEN length(r.content) > 200 THEN substring(r.content, 1, 200) || '…' ELSE r.content END AS result_preview
FROM (SELECT * FROM chunks WHERE type = 'tool_call') c
LEFT JOIN (SELECT * FROM chunks WHERE type = 'tool_result') r ON c.run_id = r.run_id AND c.tool_call_id = r.tool_call_id"""))
def j6(spark, sf):
    """Tool calls with their results (left join)."""
    return RU.call_result_pairs(_chunks(spark, sf))


@register("j3_collected_values", V(["chunks", "approvals"], """
WITH expected AS (
  SELECT DISTINCT run_id, tool_call_id, CASE WHEN type = 'approval-requested' THEN 'approval' ELSE 'result' END AS kind
  FROM chunks WHERE type IN ('approval-requested', 'tool-input-available')),
came AS (
  SELECT run_id, tool_call_id, 'result' AS kind, content AS value, seq FROM chunks WHERE type = 'tool_result'
  UNION ALL SELECT run_id, tool_call_id, 'approval', value, seq FROM approvals)
SELECT e.run_id, e.kind, e.tool_call_id, arg_max_null(c.value, c.seq) AS value
FROM expected e JOIN came c ON c.run_id = e.run_id AND c.tool_call_id = e.tool_call_id AND c.kind = e.kind
GROUP BY 1, 2, 3"""))
def j3_values(spark, sf):
    """The collected value of every expected key."""
    return RU.collected_values(_chunks(spark, sf), _dec(spark, sf))


@register("j8_pending_client_calls", V(["chunks", "messages"], f"""
WITH req AS (SELECT run_id, max(seq) AS seq, arg_max(tool_call_id, seq) AS tool_call_id,
                    arg_max(tool_name, seq) AS tool_name, arg_max(input, seq) AS input
             FROM chunks WHERE type = 'tool-input-available' GROUP BY run_id),
res AS (SELECT run_id, tool_call_id, seq AS rseq FROM chunks WHERE type = 'tool_result'),
users AS (SELECT run_id, max(pos) AS last_user_pos FROM messages WHERE role = 'user' GROUP BY run_id)
SELECT r.run_id, r.tool_call_id, r.tool_name, r.input, r.seq FROM req r LEFT JOIN users u ON r.run_id = u.run_id
WHERE NOT EXISTS (SELECT 1 FROM res x WHERE x.run_id = r.run_id AND x.tool_call_id = r.tool_call_id AND x.rseq > r.seq)
  AND (u.last_user_pos IS NULL OR u.last_user_pos <= r.seq // {K})"""))
def j8(spark, sf):
    """The client tool call a run waits on, if any."""
    return RU.pending_client_calls(_chunks(spark, sf), _msgs(spark, sf), derive.turn_of(F.col("seq")))


@register("j3_ready_runs", V(["chunks", "approvals"], f"""
WITH expected AS (
  SELECT DISTINCT run_id, tool_call_id, 'approval' AS kind FROM chunks WHERE type = 'approval-requested'
  UNION ALL SELECT DISTINCT run_id, tool_call_id, 'result' AS kind FROM chunks WHERE type = 'tool-input-available'),
collected AS (
  SELECT run_id, tool_call_id, 'approval' AS kind, arg_max_null(value, seq) AS value, true AS present
  FROM approvals GROUP BY 1, 2
  UNION ALL
  SELECT run_id, tool_call_id, 'result' AS kind, arg_max_null(content, seq) AS value, true AS present
  FROM chunks WHERE type = 'tool_result' GROUP BY 1, 2),
m AS (SELECT e.run_id, e.kind, c.value, c.present FROM expected e LEFT JOIN collected c
      ON e.run_id = c.run_id AND e.tool_call_id = c.tool_call_id AND e.kind = c.kind),
per_run AS (SELECT run_id, count(*) FILTER (WHERE kind = 'approval') AS nea, count(*) FILTER (WHERE kind = 'result') AS ner,
                   count(*) FILTER (WHERE present IS NULL) AS nm,
                   count(*) FILTER (WHERE kind = 'approval' AND present IS NOT NULL AND coalesce({_APPROVED}, false)) AS na
            FROM m GROUP BY run_id),
payload AS (SELECT DISTINCT run_id FROM collected),
runs AS (SELECT DISTINCT run_id FROM chunks)
SELECT r.run_id, coalesce(nea, 0) AS n_expected_approvals, coalesce(ner, 0) AS n_expected_results,
       coalesce(nm, 0) AS n_missing, coalesce(na, 0) AS n_approved,
       CASE WHEN coalesce(nea, 0) + coalesce(ner, 0) = 0 THEN p.run_id IS NOT NULL ELSE nm = 0 END AS ready
FROM runs r LEFT JOIN per_run pr ON r.run_id = pr.run_id LEFT JOIN payload p ON r.run_id = p.run_id"""))
def j3(spark, sf):
    """J3 + U1: can each run resume (expected approvals and results all collected)?"""
    return RU.ready_runs(_chunks(spark, sf), _dec(spark, sf))


# --- T5-T9 ----------------------------------------------------------------------

@register("t5_idle_gaps", V(["chunks"], """
SELECT run_id, seq, prev_seq, timestamp - prev_ts AS gap_ms, CAST((timestamp - prev_ts) // 15000 AS BIGINT) AS n_keepalives
FROM (SELECT run_id, seq, timestamp, lag(timestamp) OVER w AS prev_ts, lag(seq) OVER w AS prev_seq
      FROM chunks WINDOW w AS (PARTITION BY run_id ORDER BY seq))
WHERE timestamp - prev_ts > 15000"""))
def t5(spark, sf):
    """T5: idle gaps over 15 s and the keep-alives sent while waiting."""
    return RU.idle_gaps(_chunks(spark, sf))


def _requests(chunks):
    return chunks.where("type = 'approval-requested'").select("run_id", "tool_call_id", F.timestamp_millis("timestamp").alias("event_time"))


@register("t4_approval_outcomes", V(["chunks", "approvals"], """
SELECT r.run_id, r.tool_call_id, r.event_time, min(d.decided_at) AS decided_at, arg_min(d.value, d.decided_at) AS value,
       CASE WHEN min(d.decided_at) IS NULL THEN 'timed_out' ELSE 'decided' END AS status
FROM (SELECT run_id, tool_call_id, epoch_ms(timestamp) AS event_time FROM chunks WHERE type = 'approval-requested') r
LEFT JOIN approvals d ON d.run_id = r.run_id AND d.tool_call_id = r.tool_call_id
  AND d.decided_at BETWEEN r.event_time AND r.event_time + INTERVAL 300 SECOND
GROUP BY r.run_id, r.tool_call_id, r.event_time"""))
def t4(spark, sf):
    """T4: every approval request with its first decision within 5 minutes, or timed out (twin of the stream)."""
    return ST.approval_outcomes(_requests(_chunks(spark, sf)), _dec(spark, sf), 300)


@register("t5_activity_sessions", V(["chunks"], f"""
SELECT run_id, min(moment) AS session_start, max(moment) + INTERVAL {KEEPALIVE_SECONDS} SECOND AS session_end, count(*) AS n_chunks
FROM (SELECT run_id, moment, sum(fresh) OVER (PARTITION BY run_id ORDER BY moment ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT run_id, epoch_ms(timestamp) AS moment, CASE WHEN timestamp - lag(timestamp) OVER (
              PARTITION BY run_id ORDER BY timestamp) > {KEEPALIVE_SECONDS * 1000} THEN 1 ELSE 0 END AS fresh FROM chunks))
GROUP BY run_id, s"""))
def t5_sessions(spark, sf):
    """T5: activity sessions per run, cut where a run is silent for over 15 s (twin of the stream)."""
    c = _chunks(spark, sf).select("run_id", F.timestamp_millis("timestamp").alias("event_time"))
    return ST.activity_sessions_batch(c)


@register("t6_split_segments", V(["chunks"], """
SELECT run_id, seq, type,
       CAST(coalesce(sum(CASE WHEN type = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment,
       NOT (type = 'done' AND coalesce(finish_reason, '') = 'tool_calls') AS visible
FROM chunks"""))
def t6(spark, sf):
    """Segment of each chunk and whether the client sees it."""
    return RU.split_segments(_chunks(spark, sf))


@register("t7_deferred_to_chunks", V(["messages"], """
SELECT run_id, pos AS segment, 0 AS "group", 0 AS ord, 'approval-requested' AS type, call_id AS tool_call_id,
       call_tool AS tool_name_or_finish, call_id AS approval_id FROM messages WHERE role = 'user' AND call_tool = 'execute_sql'
UNION ALL
SELECT run_id, pos, 1, 0, 'tool-input-available', call_id, call_tool, NULL FROM messages
WHERE role = 'user' AND call_tool <> 'execute_sql'
UNION ALL
SELECT run_id, pos, 2, 0, 'done', NULL, CASE WHEN count(call_id) > 0 THEN 'tool_calls' ELSE 'stop' END, NULL
FROM messages WHERE role = 'user' GROUP BY run_id, pos"""))
def t7(spark, sf):
    """T7 + U2: deferred requests as chunks, approvals first, then client calls, then the segment's done."""
    return RU.deferred_to_chunks(_msgs(spark, sf))


@register("t7_call_arrays", V(["call_arrays"], """
WITH u AS (SELECT run_id, pos, list_filter(calls, lambda c: c.call_tool = 'execute_sql') AS a,
                  list_filter(calls, lambda c: c.call_tool <> 'execute_sql') AS b FROM call_arrays WHERE role = 'user')
SELECT run_id, pos AS segment, 0 AS "group", CAST(i - 1 AS INTEGER) AS ord, 'approval-requested' AS type, a[i].call_id AS tool_call_id,
       a[i].call_tool AS tool_name_or_finish, a[i].call_id AS approval_id FROM u, unnest(generate_series(1, len(a))) AS s(i)
UNION ALL
SELECT run_id, pos, 1, CAST(i - 1 AS INTEGER), 'tool-input-available', b[i].call_id, b[i].call_tool, NULL FROM u, unnest(generate_series(1, len(b))) AS s(i)
UNION ALL
SELECT run_id, pos, 2, 0, 'done', NULL, 'tool_calls', NULL FROM u"""))
def t7_arrays(spark, sf):
    """T7 with three calls a segment: each kind's calls in the order in which they were made, not of their ids."""
    return RU.deferred_to_chunks(derive.call_arrays(spark, sf))


@register("t8_close_failed_runs", V(["chunks"], """
SELECT run_id, last_seq + 1 AS seq, 'done' AS type, 'stop' AS finish_reason FROM (
  SELECT run_id, max(CASE WHEN type = 'error' THEN seq END) AS error_seq, max(CASE WHEN type = 'done' THEN seq END) AS done_seq,
         max(seq) AS last_seq FROM chunks GROUP BY run_id)
WHERE error_seq IS NOT NULL AND (done_seq IS NULL OR done_seq < error_seq)"""))
def t8(spark, sf):
    """Closing done(stop) rows for runs that failed mid-stream."""
    return RU.close_failed_runs(_chunks(spark, sf))


@register("t8_closed_stream", V(["chunks"], """
WITH s AS (
  SELECT run_id, max(CASE WHEN type = 'error' THEN seq END) AS error_seq, max(CASE WHEN type = 'done' THEN seq END) AS done_seq,
         max(seq) AS last_seq, arg_max(timestamp, seq) AS last_ms FROM chunks GROUP BY run_id)
SELECT run_id, seq, type, finish_reason, timestamp FROM chunks
UNION ALL
SELECT run_id, last_seq + 1, 'done', 'stop', last_ms FROM s
WHERE error_seq IS NOT NULL AND (done_seq IS NULL OR done_seq < error_seq)"""))
def t8_stream(spark, sf):
    """The whole chunk stream, closed."""
    return RU.closed_stream(_chunks(spark, sf)).select("run_id", "seq", "type", "finish_reason", "timestamp")


@register("t9_check_streams", V(["chunks"], f"""
WITH {_ENV_ROWS}
SELECT c.run_id, bool_or(c.type = 'done') AS has_done, bool_or(c.type = 'approval-requested') AS has_approval,
       coalesce(bool_or(e.ok), false) AS has_valid_envelope,
       coalesce(bool_or(e.ok AND len(e.arts) > 0), false) AS has_artifact,
       count(*) FILTER (WHERE c.type = 'tool_result' AND NOT coalesce(e.ok, false)) AS n_invalid_results
FROM chunks c LEFT JOIN env e ON c.run_id = e.run_id AND c.seq = e.seq GROUP BY c.run_id"""))
def t9(spark, sf):
    """Per-run stream quality report."""
    return RU.check_streams(_chunks(spark, sf))


# --- scalar functions over the derived tables -------------------------------------

@register("f1_normalize_approval", V(["approvals"], """
WITH a AS (SELECT *, CASE WHEN json_valid(value) THEN value END AS j FROM approvals),
b AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_obj,
             CASE WHEN coalesce(json_type(j, '$.kind') = 'VARCHAR', false) THEN json_extract_string(j, '$.kind') END AS kind_s
      FROM a)
SELECT run_id, tool_call_id,
       CASE WHEN trim(value) IN ('true', 'false') THEN trim(value) = 'true'
            WHEN is_obj AND kind_s = 'tool-approved' THEN true ELSE false END AS approved,
       CASE WHEN is_obj THEN kind_s END AS kind,
       CASE WHEN is_obj AND kind_s = 'tool-approved' THEN CAST(json_extract(j, '$.override_args') AS VARCHAR) END AS override_args,
       CASE WHEN is_obj AND kind_s = 'tool-denied' THEN
            CASE WHEN list_contains(json_keys(j), 'message')
                 THEN CASE WHEN json_type(j, '$.message') = 'VARCHAR' THEN json_extract_string(j, '$.message') END
                 ELSE 'The tool call was denied.' END END AS message
FROM b"""))
def f1(spark, sf):
    """posted approval values normalised."""
    d = _dec(spark, sf)
    return d.select("run_id", "tool_call_id", FA.normalize_approval(F.col("value")).alias("a")) \
            .select("run_id", "tool_call_id", "a.*")


@register("f2_approval_audit", V(["approvals"], """
WITH a AS (SELECT *, CASE WHEN json_valid(value) THEN value END AS j FROM approvals),
b AS (SELECT *, CASE WHEN coalesce(json_type(j, '$.kind') = 'VARCHAR', false) THEN json_extract_string(j, '$.kind') END AS kind_s,
             trim(value) IN ('true', 'false') AS is_bool FROM a)
SELECT run_id, tool_call_id,
       CASE WHEN is_bool THEN trim(value) = 'true' WHEN kind_s = 'tool-approved' THEN true WHEN kind_s = 'tool-denied' THEN false END AS approved,
       CASE WHEN NOT is_bool THEN kind_s END AS kind,
       CASE WHEN kind_s = 'tool-denied' AND coalesce(json_type(j, '$.message') = 'VARCHAR', false)
            THEN json_extract_string(j, '$.message') END AS denial_message,
       CASE WHEN kind_s = 'tool-approved' THEN CAST(json_extract(j, '$.override_args') AS VARCHAR) END AS override_args
FROM b WHERE is_bool OR kind_s IN ('tool-approved', 'tool-denied')"""))
def f2(spark, sf):
    """the decision log (unknown kinds are not recorded; no default message)."""
    d = _dec(spark, sf).select("run_id", "tool_call_id", FA.approval_audit_fields(F.col("value")).alias("a"))
    return d.where(F.col("a.approved").isNotNull()).select("run_id", "tool_call_id", "a.*")


@register("f3_f4_done_usage", V(["chunks"], f"""
SELECT run_id, seq, CASE WHEN finish_reason IN ('stop', 'length', 'tool_calls', 'content_filter') THEN finish_reason ELSE 'stop' END AS finish,
       CASE WHEN {_P} IS NOT NULL AND {_C} IS NOT NULL THEN {_P} END AS prompt_tokens,
       CASE WHEN {_P} IS NOT NULL AND {_C} IS NOT NULL THEN {_C} END AS completion_tokens,
       CASE WHEN {_P} IS NOT NULL AND {_C} IS NOT NULL THEN coalesce({_T}, {_P} + {_C}) END AS total_tokens
FROM chunks WHERE type = 'done'"""))
def f3_f4(spark, sf):
    """F3 + F4: finish reason and normalised usage of every done chunk."""
    d = _chunks(spark, sf).where(F.col("type") == "done")
    u = FU.usage_struct(F.col("usage"))
    return d.select("run_id", "seq", FU.finish_reason(F.col("finish_reason")).alias("finish"),
                    u.getField("promptTokens").alias("prompt_tokens"),
                    u.getField("completionTokens").alias("completion_tokens"),
                    u.getField("totalTokens").alias("total_tokens"))


@register("f5_result_preview", V(["chunks"], """
SELECT run_id, seq, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '…' ELSE content END AS preview,
       CAST(length(content) AS INTEGER) AS n_chars
FROM chunks WHERE type = 'tool_result'"""))
def f5(spark, sf):
    """log preview of every tool result (200 characters + ellipsis)."""
    d = _chunks(spark, sf).where(F.col("type") == "tool_result")
    return d.select("run_id", "seq", FE.log_preview(FE.result_text(d, "content")).alias("preview"),
                    F.length("content").alias("n_chars"))


@register("f6_parse_tool_args", V(["chunks"], """
SELECT run_id, seq, CASE WHEN coalesce(arguments, '') = '' THEN '{}' ELSE arguments END AS args,
       coalesce(arguments, '') = '' OR coalesce(json_valid(arguments), false) AS is_json
FROM chunks WHERE type = 'tool_call'"""))
def f6(spark, sf):
    """tool arguments parsed for display (empty -> {}, bad JSON kept raw)."""
    d = _chunks(spark, sf).where(F.col("type") == "tool_call")
    return d.select("run_id", "seq", FE.parse_tool_args(F.col("arguments")).alias("a")).select("run_id", "seq", "a.*")


@register("f7_parse_envelope", V(["chunks"], f"""
WITH {_ENV_ROWS}
SELECT run_id, seq, ok AS is_valid,
       CASE WHEN ok AND coalesce(json_type(j, '$.message') = 'VARCHAR', false) THEN json_extract_string(j, '$.message') END AS message,
       CASE WHEN ok THEN CAST(len(arts) AS INTEGER) END AS n_artifacts,
       CASE WHEN ok THEN json_extract_string(arts[1], '$.id') END AS first_artifact_id,
       CASE WHEN ok THEN coalesce(json_type(j, '$.data') = 'OBJECT', false) END AS has_data
FROM env"""))
def f7(spark, sf):
    """tool-result envelopes parsed (invalid -> NULL; bad artifact items dropped)."""
    d = _chunks(spark, sf).where(F.col("type") == "tool_result")
    env = FE.parse_envelope(F.col("content"))
    return d.select("run_id", "seq", env.isNotNull().alias("is_valid"), env.getField("message").alias("message"),
                    F.when(env.isNotNull(), F.size(env.getField("artifacts"))).alias("n_artifacts"),
                    env.getField("artifacts")[0].getField("id").alias("first_artifact_id"),
                    F.when(env.isNotNull(), env.getField("data_json").isNotNull()).alias("has_data"))


@register("f9_artifact_ref", V(["chunks"], """
WITH c AS (SELECT run_id, seq, trim(input) AS t FROM chunks WHERE type = 'tool-input-available'),
d AS (SELECT *, CASE WHEN json_valid(t) THEN t END AS j FROM c)
SELECT run_id, seq, CASE WHEN coalesce(t, '') = '' THEN NULL ELSE coalesce(
    NULLIF(CASE WHEN json_type(j, '$.artifact_id') = 'VARCHAR' THEN json_extract_string(j, '$.artifact_id') END, ''),
    NULLIF(CASE WHEN json_type(j, '$.artifactId') = 'VARCHAR' THEN json_extract_string(j, '$.artifactId') END, ''),
    NULLIF(CASE WHEN json_type(j, '$.input.artifact_id') = 'VARCHAR' THEN json_extract_string(j, '$.input.artifact_id') END, ''),
    NULLIF(CASE WHEN json_type(j, '$.input.artifactId') = 'VARCHAR' THEN json_extract_string(j, '$.input.artifactId') END, ''),
    t) END AS artifact_id
FROM d"""))
def f9(spark, sf):
    """artifact id of every client tool input."""
    d = _chunks(spark, sf).where(F.col("type") == "tool-input-available")
    return d.select("run_id", "seq", FE.artifact_ref(F.col("input")).alias("artifact_id"))


@register("f14_call_arguments", V(["chunks"], """
SELECT run_id, seq, CAST(to_json(arguments) AS VARCHAR) AS quoted FROM chunks WHERE type = 'tool_call'"""))
def f14(spark, sf):
    """tool arguments JSON-quoted once more (the double encoding on the wire)."""
    d = _chunks(spark, sf).where(F.col("type") == "tool_call")
    return d.select("run_id", "seq", FE.call_arguments(F.col("arguments")).alias("quoted"))
