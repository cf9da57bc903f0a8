"""Registered record queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import records as R
from ..session import DAY, NOW
from ..sources import derive
from ..sources.records import with_parsed
from ..streaming.streams import error_rollup_closed
from .oracle_views import with_views
from .registry import register

REC_COLS = ["span_id", "trace_id", "level", "service_name", "message", "attributes"]
_RC = ", ".join(REC_COLS)


def _rec(spark, sf):
    return derive.load_records(spark, sf)


@register("flagship_error_rollup", with_views(["records"], f"""
SELECT service_name, CAST(date_trunc('hour', start_timestamp) AS TIMESTAMP) AS hour,
       count(*) AS n_errors, min(start_timestamp) AS first_seen, max(start_timestamp) AS last_seen,
       count(*) FILTER (WHERE is_exception) AS n_exceptions
FROM records
WHERE level = 'error' AND start_timestamp >= TIMESTAMP '{DAY}' AND start_timestamp < TIMESTAMP '{DAY}' + INTERVAL 1 DAY
GROUP BY 1, 2"""))
def flagship_error_rollup(spark, sf):
    """N2 by service and hour for one calendar day (the 'aggregate yesterday's errors' request)."""
    return R.error_rollup(_rec(spark, sf), DAY, ["service_name", "hour"])


@register("records_scan", with_views(["records"], """
SELECT created_at, start_timestamp, end_timestamp, trace_id, span_id, parent_span_id, level, span_name, message,
       attributes_json_schema, attributes, tags, is_exception, otel_status_message, service_name FROM records"""))
def records_scan(spark, sf):
    """The records table with its fixed 15-column schema."""
    from ..schemas import RECORDS
    return _rec(spark, sf).select(*[f.name for f in RECORDS.fields])


@register("attr_equals_false", with_views(["records"], f"""
SELECT {_RC} FROM records WHERE json_extract_string(attributes, '$.foobar') = 'false'"""))
def attr_equals_false(spark, sf):
    """Attributes->>'foobar' = 'false'."""
    return R.where_attr_equals(_rec(spark, sf), "foobar", "false").select(*REC_COLS)


@register("attr_equals_value", with_views(["records"], f"""
SELECT {_RC} FROM records WHERE json_extract_string(attributes, '$.k') = '42'"""))
def attr_equals_value(spark, sf):
    """R1 on a numeric JSON value compared as text."""
    return R.where_attr_equals(_rec(spark, sf), "k", "42").select(*REC_COLS)


@register("attr_has_key", with_views(["records"], f"""
SELECT {_RC} FROM records WHERE coalesce(list_contains(json_keys(attributes), 'foobar'), false)"""))
def attr_has_key(spark, sf):
    """R2: attributes ? 'foobar' (true also for a JSON null value)."""
    return R.where_attr_has_key(_rec(spark, sf), "foobar").select(*REC_COLS)


@register("recent_as_written", with_views(["records"], f"""
SELECT {_RC}, start_timestamp FROM records
WHERE CAST(start_timestamp AS DATE) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY"""))
def recent_as_written(spark, sf):
    """The 'yesterday' example as written (keeps the current day and later)."""
    return R.where_recent(_rec(spark, sf), NOW, "as_written").select(*REC_COLS, "start_timestamp")


@register("recent_calendar_day", with_views(["records"], f"""
SELECT {_RC}, start_timestamp FROM records
WHERE start_timestamp >= CAST(CAST(TIMESTAMP '{NOW}' AS DATE) - 1 AS TIMESTAMP)
  AND start_timestamp < CAST(CAST(TIMESTAMP '{NOW}' AS DATE) AS TIMESTAMP)"""))
def recent_calendar_day(spark, sf):
    """The calendar day before NOW, as a half-open range."""
    return R.where_recent(_rec(spark, sf), NOW, "calendar_day").select(*REC_COLS, "start_timestamp")


@register("level_error", with_views(["records"], f"SELECT {_RC} FROM records WHERE level = 'error'"))
def level_error(spark, sf):
    """R5."""
    return R.where_level(_rec(spark, sf), "error").select(*REC_COLS)


@register("level_at_least_warning", with_views(["records"], f"""
SELECT {_RC} FROM records
WHERE list_position(['debug', 'info', 'warning', 'error', 'critical'], level) >= 3"""))
def level_at_least_warning(spark, sf):
    """Level >= warning by enum order."""
    return R.where_level_at_least(_rec(spark, sf), "warning").select(*REC_COLS)


@register("error_with_tag", with_views(["records"], f"""
SELECT {_RC} FROM records WHERE level = 'error' AND list_contains(tags, 'rate-limit')"""))
def error_with_tag(spark, sf):
    """R5 + R7: error records carrying the tag 'rate-limit'."""
    return R.where_tag(R.where_level(_rec(spark, sf), "error"), "rate-limit").select(*REC_COLS)


@register("row_text", with_views(["records"], """
SELECT coalesce(span_id, '') AS span_id, coalesce(parent_span_id, '') AS parent_span_id,
       coalesce(array_to_string(tags, ','), '') AS tags, coalesce(CAST(is_exception AS VARCHAR), '') AS is_exception,
       coalesce(otel_status_message, '') AS otel_status_message FROM records"""))
def row_text(spark, sf):
    """Cells as display text (arrays joined with ',', NULL as '')."""
    df = _rec(spark, sf).select("span_id", "parent_span_id", "tags", "is_exception", "otel_status_message")
    return R.project_row_text(df)


@register("search_rows", with_views(["records"], """
SELECT span_id, trace_id, level, message, service_name FROM records
WHERE contains(lower(coalesce(span_id, '')), 'svc-3') OR contains(lower(coalesce(trace_id, '')), 'svc-3')
   OR contains(lower(coalesce(level, '')), 'svc-3') OR contains(lower(coalesce(message, '')), 'svc-3')
   OR contains(lower(coalesce(service_name, '')), 'svc-3')
UNION ALL
SELECT span_id, trace_id, level, message, service_name FROM records
WHERE contains(lower(coalesce(message, '')), 'rror 7') OR contains(lower(coalesce(level, '')), 'rror 7')"""))
def search_rows(spark, sf):
    """Case-insensitive search over every text column (two needles)."""
    df = _rec(spark, sf).select("span_id", "trace_id", "level", "message", "service_name")
    a = R.search_rows(df, "SVC-3")
    b = R.search_rows(df, "rRoR 7", columns=["message", "level"])
    return a.unionByName(b)


@register("timestamps_as_text", with_views(["records"], """
SELECT span_id, strftime(start_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS start_timestamp FROM records"""))
def timestamps_as_text(spark, sf):
    """Datetime columns as text before storing (microsecond precision kept)."""
    df = _rec(spark, sf).select("span_id", "start_timestamp")
    out = R.timestamps_as_text(df)
    # fixed-width form, so both engines print the same digits
    return out.select("span_id", F.date_format(F.col("start_timestamp").cast("timestamp_ntz"),
                                               "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_timestamp"))


@register("error_count_as_written", with_views(["records"], f"""
SELECT count(*) AS error_count FROM records
WHERE level = 'error' AND CAST(start_timestamp AS DATE) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY"""))
def error_count_as_written(spark, sf):
    """N1 with the example's date rule."""
    return R.error_count(_rec(spark, sf), NOW, "as_written")


@register("error_count_calendar_day", with_views(["records"], f"""
SELECT count(*) AS error_count FROM records
WHERE level = 'error' AND start_timestamp >= TIMESTAMP '2024-01-14' AND start_timestamp < TIMESTAMP '2024-01-15'"""))
def error_count_calendar_day(spark, sf):
    """N1 for yesterday as a calendar day."""
    return R.error_count(_rec(spark, sf), NOW, "calendar_day")


@register("error_rollup_by_tag", with_views(["records"], f"""
SELECT tag, count(*) AS n_errors, min(start_timestamp) AS first_seen, max(start_timestamp) AS last_seen,
       count(*) FILTER (WHERE is_exception) AS n_exceptions
FROM (SELECT *, unnest(CASE WHEN tags IS NULL OR len(tags) = 0 THEN [NULL] ELSE tags END) AS tag FROM records
      WHERE level = 'error' AND start_timestamp >= TIMESTAMP '{DAY}' AND start_timestamp < TIMESTAMP '{DAY}' + INTERVAL 1 DAY)
GROUP BY tag"""))
def error_rollup_by_tag(spark, sf):
    """N2 by tag (explode_outer keeps untagged rows under NULL)."""
    return R.error_rollup(_rec(spark, sf), DAY, ["tag"])


@register("error_rollup_service_message_rollup", with_views(["records"], f"""
SELECT service_name, message, count(*) AS n_errors, min(start_timestamp) AS first_seen,
       max(start_timestamp) AS last_seen, count(*) FILTER (WHERE is_exception) AS n_exceptions
FROM records
WHERE level = 'error' AND start_timestamp >= TIMESTAMP '{DAY}' AND start_timestamp < TIMESTAMP '{DAY}' + INTERVAL 1 DAY
GROUP BY ROLLUP (service_name, message)"""))
def error_rollup_service_message_rollup(spark, sf):
    """N2 + N7: ROLLUP(service, message) with subtotals and a grand total."""
    return R.error_rollup(_rec(spark, sf), DAY, ["service_name", "message"], rollup=True)


@register("preview_counts", with_views(["records"], """
SELECT count(*) AS original_row_count,
       (SELECT count(*) FROM (SELECT * FROM records ORDER BY span_id LIMIT 200) p
        WHERE contains(lower(coalesce(p.message, '')), 'purchase')
           OR contains(lower(coalesce(p.service_name, '')), 'purchase')) AS filtered_row_count,
       least(count(*), 200) AS exported_row_count,
       CAST(3 AS BIGINT) AS column_count
FROM records"""))
def preview_counts(spark, sf):
    """Counts behind the preview grid (first 200 rows by span_id, needle 'purchase')."""
    df = _rec(spark, sf).select("span_id", "message", "service_name")
    return R.preview_counts(df, "purchase", 200, [F.col("span_id")], columns=["message", "service_name"])


@register("preview_first_200", with_views(["records"], """
SELECT span_id, level, start_timestamp FROM records ORDER BY start_timestamp DESC, span_id LIMIT 200"""))
def preview_first_200(spark, sf):
    """L1: the newest 200 records (top-k; the limit is the feature)."""
    df = _rec(spark, sf).select("span_id", "level", "start_timestamp")
    return R.preview(df, [F.col("start_timestamp").desc(), F.col("span_id")], 200)


@register("sort_rows_then_cap", with_views(["records"], """
SELECT span_id, service_name, level FROM records WHERE level IN ('error', 'critical')
ORDER BY service_name DESC NULLS LAST, span_id ASC NULLS LAST LIMIT 1000"""))
def sort_rows_then_cap(spark, sf):
    """L2 + L3: sort the filtered rows, then cap at the guarded-query maximum (1000)."""
    df = R.where_level_at_least(_rec(spark, sf), "error").select("span_id", "service_name", "level")
    return R.cap(R.sort_rows(df, [("service_name", "desc"), ("span_id", "asc")]), 1000)


_LABEL = """CASE event_id % 5 WHEN 0 THEN upper(level) || ' ' || (event_id % 12) WHEN 1 THEN level || ' 0' || (event_id % 12)
  WHEN 2 THEN (event_id % 30) || level WHEN 3 THEN level || ' ' || (event_id % 120) || '.' || (event_id % 7) ELSE level END"""


@register("l2_natural_sort", with_views(["records"], f"""
, labelled AS (SELECT trace_id, event_id, CASE WHEN event_id % 23 <> 0 THEN {_LABEL} END AS label FROM records),
keyed AS (
  SELECT *, [ CASE WHEN regexp_matches(p, '^[0-9]') THEN {{'k': 1, 'n': length(ltrim(p, '0')), 't': ltrim(p, '0')}}
                   ELSE {{'k': 0, 'n': 0, 't': p}} END FOR p IN regexp_extract_all(lower(label), '[0-9]+|[^0-9]+') ] AS key
  FROM labelled)
SELECT trace_id, event_id, label,
  row_number() OVER (PARTITION BY trace_id ORDER BY (label IS NULL), key, event_id) AS place,
  row_number() OVER (PARTITION BY trace_id ORDER BY (label IS NULL), key DESC, event_id) AS place_desc
FROM keyed""".replace(", labelled AS", "WITH labelled AS", 1)))
def l2_natural(spark, sf):
    """L2: all rows of each trace in the grid's natural order of a mixed label, both ways, NULLs last; no cap."""
    label = F.expr("""CASE WHEN event_id % 23 <> 0 THEN CASE event_id % 5 WHEN 0 THEN upper(level) || ' ' || (event_id % 12)
      WHEN 1 THEN level || ' 0' || (event_id % 12) WHEN 2 THEN (event_id % 30) || level
      WHEN 3 THEN level || ' ' || (event_id % 120) || '.' || (event_id % 7) ELSE level END END""")
    rows = _rec(spark, sf).select("trace_id", "event_id", label.alias("label"))
    key = R.natural_key(F.col("label"))
    up = Window.partitionBy("trace_id").orderBy(key.asc_nulls_last(), "event_id")
    down = Window.partitionBy("trace_id").orderBy(key.desc_nulls_last(), "event_id")
    return rows.withColumn("place", F.row_number().over(up).cast("long")).withColumn("place_desc", F.row_number().over(down).cast("long"))


@register("attr_filters_parsed", with_views(["records"], f"""
SELECT {_RC}, 'equals' AS filter FROM records WHERE json_extract_string(attributes, '$.foobar') = 'false'
UNION ALL
SELECT {_RC}, 'has_key' FROM records WHERE list_contains(json_keys(attributes), 'foobar')"""))
def attr_filters_parsed(spark, sf):
    """R1 and R2 on attributes parsed once into a VARIANT column (the layout that write_records stores)."""
    rec = with_parsed(_rec(spark, sf))
    equal = R.where_attr_equals(rec, "foobar", "false").select(*REC_COLS, F.lit("equals").alias("filter"))
    return equal.unionByName(R.where_attr_has_key(rec, "foobar").select(*REC_COLS, F.lit("has_key").alias("filter")))


@register("t2_error_rollup_closed", with_views(["records"], f"""
SELECT date_trunc('hour', start_timestamp) AS window_start, date_trunc('hour', start_timestamp) + INTERVAL 1 HOUR AS window_end,
       service_name, count(*) AS n_errors
FROM records WHERE level = 'error' GROUP BY 1, 2, 3
HAVING date_trunc('hour', start_timestamp) + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE"""))
def t2(spark, sf):
    """T2 (batch twin): the error windows that the stream has closed once it saw NOW."""
    return error_rollup_closed(derive.load_records(spark, sf), NOW, "1 hour", "10 minutes")
