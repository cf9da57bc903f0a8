"""Registered source queries (S2 sample rows, S9/S10 event-stream round trip)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import runs as RU
from ..session import NOW
from ..sources import derive, sse
from ..sources.records import SAMPLE_TEMPLATES, sample_records
from ..sources.tables import table
from ..streaming.streams import ingest_captures
from .oracle_views import with_views
from .registry import register


def _tpl_sql() -> str:
    items = []
    for lv, msg, svc, tags in SAMPLE_TEMPLATES:
        tl = "[" + ", ".join(f"'{t}'" for t in tags) + "]"
        items.append(f"{{'level': '{lv}', 'message': '{msg}', 'service': '{svc}', 'tags': {tl}}}")
    return "[" + ", ".join(items) + "]"


@register("s2_sample_records", f"""
SELECT TIMESTAMP '{NOW}' - INTERVAL 1 DAY + event_id * INTERVAL 1 HOUR AS start_timestamp,
       TIMESTAMP '{NOW}' - INTERVAL 1 DAY + event_id * INTERVAL 1 HOUR + INTERVAL 100 MILLISECOND AS end_timestamp,
       printf('trace-%04d', event_id) AS trace_id, printf('span-%04d', event_id) AS span_id,
       t.level AS level, t.service || '.handler' AS span_name, t.message AS message, '{{}}' AS attributes,
       t.tags AS tags, t.level = 'error' AS is_exception, t.service AS service_name
FROM (SELECT event_id, {_tpl_sql()}[CAST(event_id % 8 + 1 AS INTEGER)] AS t FROM events)""")
def s2(spark, sf):
    """Sample log rows, one per event id (template i % 8, hourly from now - 1 day)."""
    ids = table(spark, sf, "events").select(F.col("event_id").alias("i"))
    return sample_records(ids, NOW).select("start_timestamp", "end_timestamp", "trace_id", "span_id", "level",
                                           "span_name", "message", "attributes", "tags", "is_exception",
                                           "service_name")


@register("s9_sse_roundtrip", with_views(["chunks"], """
SELECT run_id, seq, type, CASE WHEN type = 'tool_call' THEN tool_name END AS call_tool,
       CASE WHEN type = 'error' THEN error_message END AS error_message
FROM chunks"""))
def s9(spark, sf):
    """S10 then S9: chunks encoded as event-stream frames (plus [DONE] and keep-alive lines), parsed back."""
    c = derive.chunks(spark, sf)
    frames = sse.encode_sse(c, with_seq=True).select(F.explode(F.split(F.col("frame"), "\n")).alias("value"))
    runs = c.select("run_id").distinct()
    extra = runs.select(F.explode(F.array(F.lit("data: [DONE]"), F.lit(": keep-alive"), F.lit("  "))).alias("value"))
    parsed = sse.parse_sse_lines(frames.unionByName(extra))
    return sse.stream_fields(parsed)


_KEYS_SORTED = """'{{' || array_to_string([ '"' || k || '":' || json_extract({c}, '$.' || k) FOR k IN list_sort(json_keys({c})) ], ',') || '}}'"""


@register("t1_ingest_captures", with_views(["chunks"], f"""
, told AS (
  SELECT *, seq // {derive.TURN_STRIDE} AS turn,
    CASE WHEN type IN ('content', 'thinking') THEN string_agg(delta, '') OVER (
      PARTITION BY run_id, seq // {derive.TURN_STRIDE}, type ORDER BY seq) ELSE content END AS whole,
    CASE WHEN type = 'tool_call' THEN count(*) OVER (PARTITION BY run_id, type ORDER BY seq) - 1 END AS idx,
    CASE WHEN type = 'error' AND length(error_message) % 2 = 0 THEN 'E1' END AS code
  FROM chunks),
placed AS (
  SELECT *, first_value(timestamp) OVER w * {sse.CAPTURE_STRIDE} + 2 * row_number() OVER w AS place
  FROM told WINDOW w AS (PARTITION BY run_id, turn ORDER BY seq))
SELECT run_id, place AS seq, type, model, timestamp, part_index, is_start, delta, role, tool_call_id, tool_name, arguments,
  CASE WHEN input IS NOT NULL THEN {_KEYS_SORTED.format(c="input")} END AS input, whole AS content, error_message,
  finish_reason, CASE WHEN usage IS NOT NULL THEN {_KEYS_SORTED.format(c="usage")} END AS usage, idx AS "index", code AS error_code
FROM placed""".replace(", told AS", "WITH told AS", 1)))
def t1_ingest(spark, sf):
    """S10 then T1, all columns: the frames of each turn, without any number, as one capture with keep-alives; the
    capture's own order gives the place of every chunk."""
    turn = Window.partitionBy("run_id", "turn", "type").orderBy("seq")
    is_text = F.col("type").isin("content", "thinking")
    c = derive.chunks(spark, sf)
    index = RU.index_tool_calls(c).select("run_id", "seq", "index")
    # a turn's rows meet once, while they are small: the window and the capture then stay where they are
    told = c.join(index, ["run_id", "seq"], "left").withColumn("turn", derive.turn_of(F.col("seq"))).repartition("run_id", "turn")
    told = told.withColumn(
        "content", F.when(is_text, F.concat_ws("", F.collect_list("delta").over(turn))).otherwise(F.col("content")))
    told = told.withColumn("error_code", F.when((F.col("type") == "error") & (F.length("error_message") % 2 == 0), F.lit("E1")))
    frames = told.select("run_id", "turn", "seq", F.concat(F.lit("data: "), sse.chunk_json(told), F.lit("\n\n")).alias("frame"))
    # a capture holds one turn: one response, bounded
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x["frame"]), "")
    captures = frames.groupBy("run_id", "turn").agg(F.concat(F.lit(": keep-alive\n\n"), text, F.lit("data: [DONE]\n\n")).alias("value"))
    return ingest_captures(captures.select("value")).drop("event_time")
