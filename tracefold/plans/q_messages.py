"""Registered message-conversion and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import approvals as FA
from ..functions import envelopes as FE
from ..operators import messages as M
from ..operators import runs as RU
from ..sources import derive
from .oracle_views import with_views
from .q_artifacts import _IDS, manifest
from .q_runs import _APPROVED, _PENDING
from .registry import register

_LOAD_SQL = """
p AS (
  SELECT run_id, pos, 'request' AS kind, 0 AS part_pos, 'system-prompt' AS part_kind, coalesce(content, '') AS content,
         CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_call_id, CAST(NULL AS VARCHAR) AS args
  FROM ui_messages WHERE role = 'system'
  UNION ALL
  SELECT run_id, pos, 'request', 0, 'user-prompt', coalesce(content, ''), NULL, NULL, NULL FROM ui_messages WHERE role = 'user'
  UNION ALL
  SELECT run_id, pos, 'response', 0, 'text', content, NULL, NULL, NULL
  FROM ui_messages WHERE role = 'assistant' AND coalesce(content, '') <> ''
  UNION ALL
  SELECT run_id, pos, 'response', CAST(i - 1 + CASE WHEN coalesce(content, '') <> '' THEN 1 ELSE 0 END AS INTEGER),
         'tool-call', NULL, tc.function.name, tc.id, tc.function.arguments
  FROM (SELECT *, unnest(toolCalls) AS tc, unnest(generate_series(1, len(toolCalls))) AS i
        FROM ui_messages WHERE role = 'assistant' AND toolCalls IS NOT NULL)
  UNION ALL
  SELECT run_id, pos, 'request', 0, 'tool-return', coalesce(content, ''),
         CASE WHEN coalesce(name, '') = '' THEN 'unknown' ELSE name END, toolCallId, NULL
  FROM ui_messages WHERE role = 'tool' AND coalesce(toolCallId, '') <> '')"""


@register("f11_load_messages", with_views(["ui_messages"], f"WITH {_LOAD_SQL} SELECT * FROM p"))
def f11(spark, sf):
    """client messages turned into model message parts."""
    return M.load_messages(derive.ui_messages(spark, sf)).select(*M.PART_COLS)


@register("f12_dump_messages", with_views(["ui_messages"], f"""
WITH {_LOAD_SQL}
SELECT run_id, pos, part_pos AS sub,
       CASE part_kind WHEN 'system-prompt' THEN 'system' WHEN 'user-prompt' THEN 'user' ELSE 'tool' END AS role,
       content, CAST(NULL AS VARCHAR) AS toolCalls,
       CASE WHEN part_kind = 'tool-return' THEN tool_call_id END AS toolCallId,
       CASE WHEN part_kind = 'tool-return' THEN tool_name END AS name
FROM p WHERE kind = 'request'
UNION ALL
SELECT run_id, pos, 0, 'assistant', string_agg(content, '' ORDER BY part_pos) FILTER (WHERE part_kind = 'text'),
       CAST(to_json(list({{'id': tool_call_id, 'function': {{'name': tool_name, 'arguments': args}}}} ORDER BY part_pos)
         FILTER (WHERE part_kind = 'tool-call')) AS VARCHAR), NULL, NULL
FROM p WHERE kind = 'response' GROUP BY run_id, pos"""))
def f12(spark, sf):
    """model message parts turned back into client messages."""
    return M.dump_messages(M.load_messages(derive.ui_messages(spark, sf))).withColumn("toolCalls", F.to_json("toolCalls"))


@register("f13_request_history", with_views(["ui_messages"], f"""
WITH {_LOAD_SQL},
last AS (SELECT run_id, max(pos) AS pos FROM p GROUP BY run_id)
SELECT p.* FROM p JOIN last USING (run_id)
WHERE p.pos <> last.pos OR EXISTS (SELECT 1 FROM p q WHERE q.run_id = p.run_id AND q.pos = p.pos AND q.part_kind <> 'user-prompt')"""))
def f13_rows(spark, sf):
    """the message parts that a request without a stored run brings as its history."""
    return M.request_history(M.load_messages(derive.ui_messages(spark, sf)))


@register("f13_history_for_run", with_views(["run_updates", "run_requests"], """
WITH lc AS (SELECT run_id, max(CASE WHEN kind = 'clear' THEN seq END) AS clear_seq FROM run_updates GROUP BY run_id),
live AS (SELECT u.* FROM run_updates u JOIN lc USING (run_id) WHERE (clear_seq IS NULL OR seq > clear_seq) AND kind <> 'clear'),
state AS (SELECT run_id, arg_max_null(messages, seq) FILTER (WHERE kind = 'set_messages') AS messages FROM live GROUP BY run_id)
SELECT r.run_id, r.turn,
       CASE WHEN s.run_id IS NOT NULL THEN 'store' WHEN r.is_continuation THEN 'error' ELSE 'request' END AS source,
       CASE WHEN s.run_id IS NULL AND NOT r.is_continuation
            THEN r.n_messages - CASE WHEN r.last_role = 'user' THEN 1 ELSE 0 END END AS n_history,
       CASE WHEN s.run_id IS NOT NULL THEN s.messages END AS stored_messages,
       CASE WHEN s.run_id IS NULL AND r.is_continuation THEN 'run_id not found in run_store for continuation' END AS error
FROM run_requests r LEFT JOIN state s ON r.run_id = s.run_id"""))
def f13(spark, sf):
    """history source of each request (store, request messages, or an error row)."""
    state = RU.fold_run_state(derive.run_updates(spark, sf))
    return M.history_for_run(derive.run_requests(spark, sf), state)


@register("f8_build_envelope", with_views(["artifacts"], f"""
WITH {_IDS}
SELECT run_id, artifact_id,
       '{{"type":"tool_result","version":1,"message":"' ||
       CASE WHEN row_count > 0 THEN 'Query ran (' || CAST(row_count AS VARCHAR) || ' rows).' ELSE 'Query returned no rows.' END || '"'
       || CASE WHEN row_count > 0 THEN ',"artifacts":[{{"id":"' || artifact_id || '","type":"' || type || '","row_count":'
                                      || CAST(row_count AS VARCHAR) || '}}]' ELSE '' END
       || CASE WHEN row_count = 0 THEN ',"data":{{"success":false}}' ELSE '' END || '}}' AS envelope
FROM ids"""))
def f8(spark, sf):
    """F8: tool-result envelope of every stored artifact (empty artifacts / data left out)."""
    m = manifest(spark, sf)
    has = F.col("row_count") > 0
    msg = F.when(has, F.concat(F.lit("Query ran ("), F.col("row_count").cast("string"), F.lit(" rows).")))\
           .otherwise(F.lit("Query returned no rows."))
    arts = F.when(has, F.array(F.struct(F.col("artifact_id").alias("id"), F.col("type").alias("type"),
                                        F.col("row_count").alias("row_count")))) \
            .otherwise(F.array().cast("array<struct<id:string,type:string,row_count:bigint>>"))
    data = F.when(~has, F.create_map(F.lit("success"), F.lit(False))).otherwise(F.create_map().cast("map<string,boolean>"))
    return m.select("run_id", "artifact_id", FE.build_envelope(msg, arts, data).alias("envelope"))


@register("f10_approval_status", with_views(["chunks", "approvals"], f"""
WITH {_PENDING},
calls AS (SELECT run_id, tool_call_id, seq FROM chunks WHERE type = 'tool_call'),
asked AS (SELECT DISTINCT run_id, tool_call_id FROM chunks WHERE type = 'approval-requested'),
answered AS (SELECT DISTINCT run_id, tool_call_id FROM chunks WHERE type = 'tool_result'),
dec AS (SELECT run_id, tool_call_id, arg_max(value, seq) AS value FROM approvals GROUP BY 1, 2),
dec2 AS (SELECT run_id, tool_call_id, {_APPROVED} AS approved FROM dec)
SELECT c.run_id, c.tool_call_id, c.seq,
       CASE WHEN (a.run_id IS NOT NULL OR p.run_id IS NOT NULL) AND d.approved IS NULL THEN 'approval-requested'
            WHEN (a.run_id IS NOT NULL OR p.run_id IS NOT NULL) AND d.approved THEN 'approved'
            WHEN (a.run_id IS NOT NULL OR p.run_id IS NOT NULL) THEN 'denied'
            WHEN r.run_id IS NOT NULL THEN 'output-available' ELSE 'input-available' END AS status
FROM calls c
LEFT JOIN asked a ON c.run_id = a.run_id AND c.tool_call_id = a.tool_call_id
LEFT JOIN answered r ON c.run_id = r.run_id AND c.tool_call_id = r.tool_call_id
LEFT JOIN dec2 d ON c.run_id = d.run_id AND c.tool_call_id = d.tool_call_id
LEFT JOIN pending p ON c.run_id = p.run_id AND c.tool_call_id = p.tool_call_id"""))
def f10(spark, sf):
    """status label of every tool-call part (approval-requested / approved / denied / own state)."""
    ch = derive.chunks(spark, sf)
    dec = derive.approvals(spark, sf)
    keys = ["run_id", "tool_call_id"]
    calls = ch.where(F.col("type") == "tool_call").select("run_id", "tool_call_id", "seq")
    asked = ch.where(F.col("type") == "approval-requested").select(*keys).distinct().withColumn("asked", F.lit(True))
    answered = ch.where(F.col("type") == "tool_result").select(*keys).distinct().withColumn("answered", F.lit(True))
    latest = dec.groupBy(*keys).agg(F.max_by("value", "seq").alias("value")) \
                .select(*keys, FA.normalize_approval(F.col("value")).getField("approved").alias("approved"))
    pending = RU.pending_approvals(ch, dec).select(*keys).withColumn("pending", F.lit(True))
    j = (calls.join(asked, keys, "left").join(answered, keys, "left")
         .join(latest, keys, "left").join(pending, keys, "left"))
    state = F.when(F.col("answered"), F.lit("output-available")).otherwise(F.lit("input-available"))
    return j.select("run_id", "tool_call_id", "seq",
                    FA.approval_status(F.col("asked"), F.col("approved"), F.col("pending"), state).alias("status"))
