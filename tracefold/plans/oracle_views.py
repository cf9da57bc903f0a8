"""SQL twins of ``tracefold.sources.derive`` (DuckDB dialect), as CTEs.

The driver tables are visible as views; the derived tables are spelled out here
once and prefixed to every twin that needs them via :func:`with_views`.
"""

from __future__ import annotations

from ..sources.derive import (CALL_NUMBERS, EPOCH_MS, STATEMENTS, SUB_DECISION, SUB_ERROR, SUB_REQUEST, SUB_RESULT,
                              SUB_SEGMENT_DONE, SUB_TOOL_CALL, TURN_STRIDE)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


K = TURN_STRIDE

VIEWS: dict[str, str] = {}

VIEWS["records"] = """
records AS (
  SELECT CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) AS start_timestamp,
         CAST(ts AS TIMESTAMP) + INTERVAL 100 MILLISECOND AS end_timestamp,
         'trace-' || CAST(user_id AS VARCHAR) AS trace_id,
         'span-' || CAST(event_id AS VARCHAR) AS span_id,
         CASE WHEN event_id % 4 <> 0 THEN 'span-' || CAST(event_id - event_id % 4 AS VARCHAR) END AS parent_span_id,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info'
                         WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'critical' END AS level,
         'svc-' || CAST(user_id % 8 AS VARCHAR) || '.handler' AS span_name,
         event_type || ' ' || CAST(event_id % 10 AS VARCHAR) AS message,
         '{"type":"object"}' AS attributes_json_schema,
         CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 7 = 0 THEN '{"foobar":false}'
              WHEN event_id % 11 = 0 THEN '{"foobar":null}' ELSE props END AS attributes,
         CASE WHEN event_id % 17 = 0 THEN NULL
              WHEN event_id % 13 = 0 THEN ['production', event_type, 'rate-limit']
              ELSE ['production', event_type] END AS tags,
         event_type = 'error' AS is_exception,
         CASE WHEN event_type = 'error' THEN event_type || ' ' || CAST(event_id % 10 AS VARCHAR) END AS otel_status_message,
         'svc-' || CAST(user_id % 8 AS VARCHAR) AS service_name,
         event_id, user_id
  FROM events)"""

VIEWS["conv"] = f"""
conv AS (
  SELECT 'run-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS run_id, conv_id, turn, role, text,
         'model-' || CAST(conv_id % 3 AS VARCHAR) AS model,
         {EPOCH_MS} + conv_id * 3600000 + turn * 30000 AS turn_ms
  FROM conversations)"""

VIEWS["messages"] = """
messages AS (
  SELECT run_id, turn AS pos, role, text AS content,
         CASE WHEN role = 'user' THEN run_id || '-' || CAST(turn AS VARCHAR) END AS call_id,
         CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'execute_sql' ELSE 'export_csv' END END AS call_tool,
         CASE WHEN role = 'assistant' THEN run_id || '-' || CAST(turn - CASE WHEN turn % 4 = 3 THEN 3 ELSE 1 END AS VARCHAR) END AS return_id
  FROM conv)"""

_TOOL_INPUT = f"""CASE WHEN turn % 4 = 0
           THEN '{{"sql":"' || {_sql_list(STATEMENTS)}[CAST((conv_id + turn) % 16 + 1 AS INTEGER)] || '"}}'
           ELSE '{{"artifact_id":"a_' || substring(run_id, 1, 8) || '_' || CAST(turn // 2 + 1 AS VARCHAR) || '"}}' END"""


def _usage(turn: str) -> str:
    p = f"CAST(100 + ({turn}) * 10 + conv_id % 50 AS VARCHAR)"
    c = f"CAST(20 + ({turn}) * 3 AS VARCHAR)"
    t = f"CAST(100 + ({turn}) * 10 + conv_id % 50 + 20 + ({turn}) * 3 AS VARCHAR)"

    def obj(pk, ck, tk):
        return (f"'{{' || concat_ws(',', CASE WHEN conv_id % 9 <> 0 THEN '\"{pk}\":' || {p} END, "
                f"'\"{ck}\":' || {c}, CASE WHEN conv_id % 2 <> 1 THEN '\"{tk}\":' || {t} END) || '}}'")

    return (f"CASE conv_id % 4 WHEN 0 THEN {obj('prompt_tokens', 'completion_tokens', 'total_tokens')} "
            f"WHEN 1 THEN {obj('promptTokens', 'completionTokens', 'totalTokens')} "
            f"WHEN 2 THEN {obj('input_tokens', 'output_tokens', 'total_tokens')} "
            f"ELSE {obj('inputTokens', 'outputTokens', 'totalTokens')} END")


_ART_PREV = "'a_' || substring(run_id, 1, 8) || '_' || CAST((turn - 1) // 2 + 1 AS VARCHAR)"
_ROWS = "CAST(turn * 7 + conv_id % 13 AS VARCHAR)"
_ENVELOPE = f"""CASE (conv_id + turn) % 7
  WHEN 0 THEN '{{"type":"tool_result","version":1,"message":"Query ran (rows: ' || {_ROWS} || ')","artifacts":[{{"id":"' || {_ART_PREV} || '","type":"table","row_count":' || {_ROWS} || '}}]}}'
  WHEN 1 THEN '{{"type":"tool_result","version":1,"message":"Error: query failed","data":{{"success":false}}}}'
  WHEN 2 THEN '{{"type":"tool_result","version":2,"message":"newer format"}}'
  WHEN 3 THEN '{{"type":"other","version":1,"message":"not a tool result"}}'
  WHEN 4 THEN '{{"type":"tool_result","version":1,"artifacts":[{{"id":7}},{{"id":"' || {_ART_PREV} || '","type":"table"}}]}}'
  WHEN 5 THEN '{{"type":"tool_result","version":1}}'
  ELSE 'plain text result' END"""

_NULLS = dict(part_index="CAST(NULL AS BIGINT)", is_start="CAST(NULL AS BOOLEAN)", delta="CAST(NULL AS VARCHAR)",
              role="CAST(NULL AS VARCHAR)", tool_call_id="CAST(NULL AS VARCHAR)", tool_name="CAST(NULL AS VARCHAR)",
              arguments="CAST(NULL AS VARCHAR)", input="CAST(NULL AS VARCHAR)", content="CAST(NULL AS VARCHAR)",
              error_message="CAST(NULL AS VARCHAR)", finish_reason="CAST(NULL AS VARCHAR)", usage="CAST(NULL AS VARCHAR)")


def _chunk_select(seq: str, typ: str, ts: str, src: str, **cols) -> str:
    vals = dict(_NULLS)
    vals.update(cols)
    body = ", ".join(f"{v} AS {k}" for k, v in vals.items())
    return (f"SELECT run_id, CAST({seq} AS BIGINT) AS seq, {typ} AS type, model, CAST({ts} AS BIGINT) AS timestamp, "
            f"{body} FROM {src}")


_TOOL = "CASE WHEN turn % 4 = 0 THEN 'execute_sql' ELSE 'export_csv' END"
_CALL_ID = "run_id || '-' || CAST(turn AS VARCHAR)"

VIEWS["chunks"] = f"""
words AS (
  SELECT *, unnest(string_split(text, ' ')) AS word,
         unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS idx
  FROM conv WHERE role IN ('assistant', 'system')),
conv_last AS (
  SELECT run_id, conv_id, model, max(turn) AS turn, arg_max(role, turn) AS last_role, max(turn_ms) AS turn_ms
  FROM conv GROUP BY run_id, conv_id, model),
chunks AS (
  {_chunk_select(f"turn * {K} + idx", "CASE WHEN role = 'assistant' THEN 'content' ELSE 'thinking' END",
                 "turn_ms + idx * 50", "words", part_index="CAST(0 AS BIGINT)", is_start="idx = 0",
                 delta="CASE WHEN idx = 0 THEN word ELSE ' ' || word END",
                 role="CASE WHEN role = 'assistant' THEN 'assistant' END")}
  UNION ALL
  {_chunk_select(f"turn * {K} + {SUB_TOOL_CALL}", "'tool_call'", "turn_ms + 20000", "conv WHERE role = 'user'",
                 tool_call_id=_CALL_ID, tool_name=_TOOL, arguments=_TOOL_INPUT)}
  UNION ALL
  {_chunk_select(f"turn * {K} + {SUB_REQUEST}",
                 "CASE WHEN turn % 4 = 0 THEN 'approval-requested' ELSE 'tool-input-available' END",
                 "turn_ms + 20001", "conv WHERE role = 'user'", tool_call_id=_CALL_ID, tool_name=_TOOL, input=_TOOL_INPUT)}
  UNION ALL
  {_chunk_select(f"turn * {K} + {SUB_SEGMENT_DONE}", "'done'", "turn_ms + 20002",
                 "conv WHERE role = 'user' AND turn % 4 = 0", finish_reason="'tool_calls'", usage=_usage("turn"))}
  UNION ALL
  {_chunk_select(f"(turn - 1) * {K} + {SUB_RESULT}", "'tool_result'", "turn_ms - 5000",
                 "conv WHERE role = 'assistant' AND turn >= 1",
                 tool_call_id="run_id || '-' || CAST(turn - 1 AS VARCHAR)", content=_ENVELOPE)}
  UNION ALL
  {_chunk_select(f"turn * {K} + {SUB_ERROR}", "'error'", "turn_ms + 29000", "conv_last WHERE conv_id % 23 = 0",
                 error_message="'model call failed for ' || run_id")}
  UNION ALL
  {_chunk_select(f"(turn + 1) * {K}", "'done'", "turn_ms + 29500", "conv_last WHERE conv_id % 23 <> 0",
                 finish_reason="CASE WHEN last_role = 'assistant' THEN 'stop' ELSE 'tool_calls' END",
                 usage=_usage("turn + 1"))}
)"""

VIEWS["approvals"] = f"""
approvals AS (
  SELECT run_id, run_id || '-' || CAST(turn AS VARCHAR) AS tool_call_id, turn * {K} + {SUB_DECISION} AS seq,
         CASE (conv_id + turn) % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false'
              WHEN 2 THEN '{{"kind":"tool-approved","override_args":{{"sql":"SELECT 1"}}}}'
              WHEN 3 THEN '{{"kind":"tool-denied","message":"not now"}}'
              WHEN 4 THEN '{{"kind":"tool-denied"}}' ELSE '{{"kind":"escalate"}}' END AS value,
         epoch_ms(turn_ms + 20001 + ((conv_id + turn) % 9) * 60000) AS decided_at
  FROM conv WHERE role = 'user' AND (conv_id + turn) % 5 <> 0)"""

VIEWS["run_updates"] = """
run_updates AS (
  SELECT run_id, turn * 10 + 1 AS seq,
         CASE WHEN turn % 2 = 0 THEN 'set_messages' ELSE 'set_pending' END AS kind,
         CASE WHEN turn % 2 = 0 THEN 'history@' || CAST(turn AS VARCHAR) END AS messages,
         CASE WHEN turn % 2 <> 0 AND turn % 3 <> 0 THEN 'pending@' || CAST(turn AS VARCHAR) END AS pending,
         CASE WHEN turn % 5 <> 0 THEN 'model-' || CAST((conv_id + turn) % 3 AS VARCHAR) END AS model,
         epoch_ms(turn_ms) AS written_at
  FROM conv
  UNION ALL
  SELECT run_id, turn * 10 AS seq, 'clear' AS kind, NULL, NULL, NULL, epoch_ms(turn_ms - 1) AS written_at
  FROM conv WHERE conv_id % 10 = 0 AND turn = 2
  UNION ALL
  SELECT run_id, max(turn) * 10 + 5 AS seq, 'clear' AS kind, NULL, NULL, NULL, epoch_ms(max(turn_ms) + 1) AS written_at
  FROM conv WHERE conv_id % 7 = 0 GROUP BY run_id)"""

VIEWS["artifacts"] = """
artifact_items AS (SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY l_orderkey),
artifacts AS (
  SELECT 'run-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 8, '0') AS run_id, o_orderkey AS result_key,
         'table' AS type, CAST(coalesce(i.row_count, 0) AS BIGINT) AS row_count, CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders o LEFT JOIN artifact_items i ON o.o_orderkey = i.l_orderkey)"""

VIEWS["statements"] = f"""
statements AS (
  SELECT event_id AS stmt_id, 'run-' || lpad(CAST(user_id % 100 AS VARCHAR), 8, '0') AS run_id,
         CAST(ts AS TIMESTAMP) AS submitted_at,
         {_sql_list(STATEMENTS)}[CAST(event_id % 16 + 1 AS INTEGER)] AS sql
  FROM events)"""

_RET_TURN = "(turn - CASE WHEN turn % 4 = 3 THEN 3 ELSE 1 END)"
VIEWS["ui_messages"] = f"""
ui_messages AS (
  SELECT run_id, turn * 3 AS pos, 'user' AS role, text AS content, NULL AS toolCalls, NULL AS toolCallId, NULL AS name
  FROM conv WHERE role = 'user'
  UNION ALL
  SELECT run_id, turn * 3 + 1, 'assistant', NULL,
         [{{'id': {_CALL_ID}, 'type': 'function', 'function': {{'name': {_TOOL}, 'arguments': {_TOOL_INPUT}}}}}],
         NULL, NULL
  FROM conv WHERE role = 'user'
  UNION ALL
  SELECT run_id, turn * 3, 'tool', {_ENVELOPE.replace(chr(10), ' ')}, NULL,
         run_id || '-' || CAST({_RET_TURN} AS VARCHAR),
         CASE WHEN turn % 5 <> 0 THEN CASE WHEN {_RET_TURN} % 4 = 0 THEN 'execute_sql' ELSE 'export_csv' END END
  FROM conv WHERE role = 'assistant'
  UNION ALL
  SELECT run_id, turn * 3 + 1, 'assistant', text, NULL, NULL, NULL FROM conv WHERE role = 'assistant'
  UNION ALL
  SELECT run_id, turn * 3, 'system', text, NULL, NULL, NULL FROM conv WHERE role = 'system')"""

_N = CALL_NUMBERS
_CALL_TOOL = "CASE WHEN (turn + {k}) % 2 = 0 THEN 'execute_sql' ELSE 'export_csv' END"
_CALLS = "[" + ", ".join(f"{{'call_id': run_id || '-' || turn || '-{n}', 'call_tool': {_CALL_TOOL.format(k=k)}}}" for k, n in enumerate(_N)) + "]"
VIEWS["call_arrays"] = f"""
call_arrays AS (
  SELECT run_id, turn * 10 AS pos, role, CASE WHEN role = 'user' THEN {_CALLS} END AS calls,
         CASE WHEN role = 'user' THEN [x.call_id FOR x IN {_CALLS}] END AS call_ids, CAST(NULL AS VARCHAR) AS return_id
  FROM conv WHERE role <> 'assistant'
  UNION ALL
  SELECT run_id, turn * 10 + k, 'tool', NULL, NULL, run_id || '-' || CASE WHEN (conv_id + turn + k) % 9 = 0 THEN 'lost'
         ELSE CAST({_RET_TURN} AS VARCHAR) END || '-' || CAST({sorted(_N)}[k + 1] AS VARCHAR)
  FROM conv, (SELECT unnest([0, 1, 2]) AS k) WHERE role = 'assistant')"""

VIEWS["run_requests"] = """
run_requests AS (
  SELECT run_id, turn, turn * 3 + 1 AS n_messages, 'user' AS last_role,
         turn > 0 AND (conv_id + turn) % 3 = 0 AS is_continuation
  FROM conv WHERE role = 'user')"""

DEPS = {
    "records": [], "conv": [], "messages": ["conv"], "chunks": ["conv"], "approvals": ["conv"],
    "run_updates": ["conv"], "artifacts": [], "statements": [], "ui_messages": ["conv"],
    "run_requests": ["conv"], "call_arrays": ["conv"],
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (dependencies first)."""
    order: list[str] = []

    def add(n):
        for d in DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",".join(VIEWS[n] for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
