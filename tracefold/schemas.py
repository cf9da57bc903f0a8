"""Schemas and fixed values.

Everything under "Fixed values" must equal the behaviour being reproduced; it is
stated plainly, in its natural order, and not derived.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Log level enum, in declaration order (debug < info < warning < error < critical).
LEVELS = ["debug", "info", "warning", "error", "critical"]

# Statement keywords the textual guard refuses, in the order they are tested.
FORBIDDEN_KEYWORDS = [
    "UPDATE", "DELETE", "DROP", "INSERT", "ALTER", "TRUNCATE",
    "CREATE", "GRANT", "REVOKE", "EXECUTE", "CALL",
]
FORBIDDEN_MESSAGE = "Error: {kw} statements are not allowed for safety reasons."
SELECT_ONLY_MESSAGE = "Error: Only SELECT queries are allowed for safety."

# Default row cap of a guarded query and default preview size.
SQL_MAX_LIMIT = 1000
PREVIEW_ROWS = 200
# Artifact lifetime in minutes; keep-alive interval while a run waits, in seconds.
ARTIFACT_TTL_MINUTES = 30
KEEPALIVE_SECONDS = 15

# Stream chunk kinds.
CHUNK_TYPES = [
    "content", "thinking", "tool_call", "tool_result",
    "tool-input-available", "approval-requested", "error", "done",
]
# Finish reasons a done chunk may carry; anything else becomes "stop".
FINISH_REASONS = ["stop", "length", "tool_calls", "content_filter"]

# Approval object kinds and the default denial text.
APPROVED_KIND = "tool-approved"
DENIED_KIND = "tool-denied"
DEFAULT_DENIAL = "The tool call was denied."

# Usage field aliases, first present wins.
PROMPT_ALIASES = ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"]
COMPLETION_ALIASES = ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"]
TOTAL_ALIASES = ["total_tokens", "totalTokens"]

# Tool-result envelope: type tag and version.
ENVELOPE_TYPE = "tool_result"
ENVELOPE_VERSION = 1

# Log preview of a tool result: characters kept and the ellipsis appended.
RESULT_PREVIEW_CHARS = 200
ELLIPSIS = "…"

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

RECORDS = T.StructType([
    T.StructField("created_at", T.TimestampType()),
    T.StructField("start_timestamp", T.TimestampType()),
    T.StructField("end_timestamp", T.TimestampType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("span_name", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("attributes_json_schema", T.StringType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_exception", T.BooleanType()),
    T.StructField("otel_status_message", T.StringType()),
    T.StructField("service_name", T.StringType()),
])

USAGE = T.StructType([
    T.StructField("promptTokens", T.LongType()),
    T.StructField("completionTokens", T.LongType()),
    T.StructField("totalTokens", T.LongType()),
])

# One wide table for all chunk kinds; per-kind columns are NULL elsewhere.
CHUNKS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("part_index", T.LongType()),
    T.StructField("is_start", T.BooleanType()),
    T.StructField("delta", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("arguments", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("usage", T.StringType()),
])

ARTIFACT_MANIFEST = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("artifact_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("capped_row_count", T.LongType()),
    T.StructField("was_capped", T.BooleanType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("location", T.StringType()),
])

ENVELOPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("artifacts", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])
