"""Registered artifact queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import api
from ..functions import envelopes as FE
from ..functions.envelopes import artifact_ref
from ..operators import artifacts as A
from ..operators import records as R
from ..session import checkpoint_dir
from ..sources import artifacts as store
from ..sources import derive
from ..sources.artifacts import csv_rows
from .oracle_views import with_views
from .registry import register

# "now" of the artifact store for the derived manifest (orders span 1995-2001) and a 30-day lifetime
ART_NOW = "1998-08-02 00:00:00"
ART_TTL_MIN = 30 * 24 * 60

_IDS = """
ids AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at, result_key) AS counter,
               'a_' || CASE WHEN coalesce(run_id, '') = '' THEN 'unknown' ELSE substring(run_id, 1, 8) END
               || '_' || CAST(row_number() OVER (PARTITION BY run_id ORDER BY created_at, result_key) AS VARCHAR) AS artifact_id
        FROM artifacts)"""
_LIVE = f"NOT (TIMESTAMP '{ART_NOW}' - created_at > INTERVAL {ART_TTL_MIN} MINUTE)"
_REQS = """
reqs AS (SELECT run_id, seq, CASE WHEN coalesce(trim(input), '') = '' THEN NULL ELSE coalesce(
           NULLIF(CASE WHEN json_type(j, '$.artifact_id') = 'VARCHAR' THEN json_extract_string(j, '$.artifact_id') END, ''),
           NULLIF(CASE WHEN json_type(j, '$.artifactId') = 'VARCHAR' THEN json_extract_string(j, '$.artifactId') END, ''),
           trim(input)) END AS artifact_id
         FROM (SELECT *, CASE WHEN json_valid(trim(input)) THEN trim(input) END AS j FROM chunks
               WHERE type = 'tool-input-available'))"""


def manifest(spark, sf):
    """The derived artifact manifest with W4 ids."""
    return A.assign_artifact_ids(derive.artifacts(spark, sf))


def _requests(spark, sf):
    c = derive.chunks(spark, sf).where(F.col("type") == "tool-input-available")
    return c.select("run_id", "seq", artifact_ref(F.col("input")).alias("artifact_id"))


@register("w4_assign_artifact_ids", with_views(["artifacts"], f"WITH {_IDS} SELECT run_id, result_key, counter, artifact_id FROM ids"))
def w4(spark, sf):
    """a_<run prefix>_<n> per run in creation order."""
    return manifest(spark, sf).select("run_id", "result_key", "counter", "artifact_id")


@register("w5_random_artifact_ids", with_views(["artifacts"], """
SELECT run_id, result_key, 'a_' || substring(run_id, 1, 8) || '_' || substring(md5(run_id || ':' || CAST(result_key AS VARCHAR)), 1, 8) AS artifact_id
FROM artifacts"""))
def w5(spark, sf):
    """a_<run prefix>_<8 hex> ids, deterministic per (run, result)."""
    return A.assign_random_artifact_ids(derive.artifacts(spark, sf)).select("run_id", "result_key", "artifact_id")


@register("t10_expire", with_views(["artifacts"], f"WITH {_IDS} SELECT run_id, artifact_id, created_at FROM ids WHERE {_LIVE}"))
def t10(spark, sf):
    """Live artifacts (now - created_at > ttl expires, strictly)."""
    return A.expire(manifest(spark, sf), ART_NOW, ART_TTL_MIN).select("run_id", "artifact_id", "created_at")


@register("t11_list_artifacts", with_views(["artifacts"], f"""
WITH {_IDS} SELECT run_id, artifact_id FROM ids WHERE {_LIVE} AND run_id = 'run-00000007'"""))
def t11(spark, sf):
    """Live artifact ids of one run."""
    return A.list_artifacts(manifest(spark, sf), ART_NOW, ART_TTL_MIN, "run-00000007")


@register("n6_artifact_stats", with_views(["artifacts"], f"""
WITH {_IDS}
SELECT run_id, count(*) AS n_artifacts, CAST(sum(row_count) AS BIGINT) AS total_rows,
       count(*) FILTER (WHERE {_LIVE}) AS n_live, count(*) FILTER (WHERE NOT ({_LIVE})) AS n_expired,
       max(created_at) AS last_created_at
FROM ids GROUP BY run_id"""))
def n6(spark, sf):
    """Artifacts per run, rows, live vs expired."""
    return A.artifact_stats(manifest(spark, sf), ART_NOW, ART_TTL_MIN)


@register("j4_artifact_exists", with_views(["artifacts", "chunks"], f"""
WITH {_IDS}, {_REQS}
SELECT r.run_id, r.seq, r.artifact_id, CASE WHEN l.artifact_id IS NOT NULL THEN 'ok' ELSE 'missing' END AS status
FROM reqs r LEFT JOIN (SELECT run_id, artifact_id FROM ids WHERE {_LIVE}) l
  ON r.run_id = l.run_id AND r.artifact_id = l.artifact_id"""))
def j4(spark, sf):
    """Export requests checked against live artifacts of the same run."""
    return A.artifact_exists(_requests(spark, sf), manifest(spark, sf), ART_NOW, ART_TTL_MIN) \
            .select("run_id", "seq", "artifact_id", "status")


@register("j5_lookup_artifact", with_views(["artifacts", "chunks"], f"""
WITH {_IDS}, {_REQS}
SELECT r.run_id, r.seq, r.artifact_id, i.row_count, i.created_at
FROM reqs r JOIN ids i ON r.run_id = i.run_id AND r.artifact_id = i.artifact_id"""))
def j5(spark, sf):
    """Artifacts found by the composite key (run_id, artifact_id)."""
    m = manifest(spark, sf).select("run_id", "artifact_id", "row_count", "created_at")
    return A.lookup_artifact(m, _requests(spark, sf)).select("run_id", "seq", "artifact_id", "row_count", "created_at")


@register("l1_preview_artifacts", with_views(["artifacts"], f"""
WITH {_IDS} SELECT run_id, artifact_id, row_count, created_at FROM ids
ORDER BY created_at DESC, run_id, artifact_id LIMIT 200"""))
def l1(spark, sf):
    """L1: preview of the newest 200 manifest rows (top-k; the limit is the feature)."""
    m = manifest(spark, sf).select("run_id", "artifact_id", "row_count", "created_at")
    return R.preview(m, [F.col("created_at").desc(), F.col("run_id"), F.col("artifact_id")], 200)


def _csv_sql(cols):
    parts = []
    for c, expr in cols:
        s = f"coalesce({expr}, '')"
        parts.append(f"CASE WHEN contains({s}, ',') OR contains({s}, chr(10)) OR contains({s}, '\"') "
                     f"THEN '\"' || replace({s}, '\"', '\"\"') || '\"' ELSE {s} END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


_CSV_COLS = [("span_id", "span_id"), ("message", "message"), ("attributes", "attributes"),
             ("tags", "array_to_string(tags, ',')"), ("is_exception", "CAST(is_exception AS VARCHAR)"),
             ("otel_status_message", "otel_status_message")]


@register("s8_csv_rows", with_views(["records"], f"SELECT {_csv_sql(_CSV_COLS)} AS csv_line FROM records"))
def s8(spark, sf):
    """Records as CSV lines by the export quoting rule."""
    df = derive.load_records(spark, sf).select(*[c for c, _ in _CSV_COLS])
    return csv_rows(df)


# ---------------------------------------------------------------------------
# the store itself: results written to the shared folder and read back
# ---------------------------------------------------------------------------

_STORED = "span_id, service_name, level, start_timestamp"


def _store(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _errors(spark, sf):
    rec = R.where_level(derive.load_records(spark, sf), "error")
    return rec.select(*_STORED.split(", ")).orderBy("span_id")


@register("t12_read_artifact", with_views(["records"], f"""
SELECT span_id, service_name, level, strftime(start_timestamp, '%Y-%m-%d %H:%M:%S') AS start_timestamp
FROM records WHERE level = 'error' ORDER BY span_id LIMIT 1000"""))
def t12(spark, sf):
    """S6 then T12: the first 1000 error records stored as an artifact of a run, found by its id and read back."""
    root = _store(spark, "t12")
    ref = store.write_artifact(_errors(spark, sf), "run-t12", root, 1000)
    back = store.read_artifact(spark, root, "run-t12", ref.id)
    return back.withColumn("start_timestamp", F.substring("start_timestamp", 1, 19))


@register("t13_artifact_preview", with_views(["records"], f"""
SELECT span_id, service_name, level, strftime(start_timestamp, '%Y-%m-%d %H:%M:%S') AS start_timestamp,
  (SELECT count(*) > 1000 FROM records WHERE level = 'error') AS was_capped,
  (SELECT least(count(*), 1000) FROM records WHERE level = 'error') AS row_count
FROM records WHERE level = 'error' ORDER BY span_id LIMIT 200"""))
def t13(spark, sf):
    """S6 then T13: the preview of a stored artifact (its first 200 rows), with what the manifest says of it."""
    root = _store(spark, "t13")
    ref = store.write_artifact(_errors(spark, sf), "run-t13", root, 1000)
    said = store.read_manifest(spark, root).where(F.col("artifact_id") == ref.id).first()  # one row of metadata
    shown = store.artifact_data(spark, root, "run-t13", ref.id, n=200)["preview"]
    return shown.withColumn("start_timestamp", F.substring("start_timestamp", 1, 19)).withColumns(
        {"was_capped": F.lit(said.was_capped), "row_count": F.lit(said.row_count).cast("long")})


@register("s7_export_csv", with_views(["records"], """
SELECT span_id, replace(coalesce(message, ''), ' ', '", ' || chr(10)) AS message, coalesce(attributes, '') AS attributes,
  coalesce(array_to_string(tags, ','), '') AS tags FROM records"""))
def s7(spark, sf):
    """Records with quotes, commas, line ends and arrays exported as CSV, and read back with an ordinary CSV reader."""
    path = _store(spark, "s7")
    rec = derive.load_records(spark, sf).select("span_id", F.replace("message", F.lit(" "), F.lit('", \n')).alias("message"), "attributes", "tags")
    store.export_csv(rec, path)
    back = spark.read.schema("span_id string, message string, attributes string, tags string").option("header", True).option(
        "multiLine", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)
    return back.na.fill("")


_SAID = {
    "all": ("SELECT span_id FROM records", "SELECT span_id FROM records"),
    "levels": ("SELECT level, count(*) AS n FROM records GROUP BY level",) * 2,
    "none": ("SELECT span_id FROM records WHERE level = 'no such level'",) * 2,
    "write": ("DROP TABLE records", None),
    "unknown": ("SELECT * FROM no_such_table", None),
}


@register("g8_envelopes", with_views(["records"], " UNION ALL ".join(
    f"""SELECT '{name}' AS statement, count(*) >= 0 AS success, CAST(least(count(*), 1000) AS DOUBLE) AS row_count,
  'Query ran (' || least(count(*), 1000) || ' rows' || CASE WHEN count(*) > 1000 THEN ', capped' ELSE '' END || ').' AS message
FROM ({sql[1]}) q""" if sql[1] else f"SELECT '{name}', false, NULL, NULL" for name, sql in _SAID.items())))
def g8(spark, sf):
    """The agent's tool call on each statement, and the envelopes it gets (of failures, that they failed)."""
    root = _store(spark, "g8")
    derive.load_records(spark, sf).createOrReplaceTempView("records")
    told = [(name, api.execute_sql(spark, "run-g8", sql, root, allowed_tables={"records"})) for name, (sql, _) in _SAID.items()]
    said = spark.createDataFrame(told, "statement string, envelope string").select("statement", FE.parse_envelope(F.col("envelope")).alias("e"))
    failed = F.coalesce(F.get_json_object("e.data_json", "$.success") == "false", F.lit(False))
    return said.where(F.col("e").isNotNull()).select(
        "statement", (~failed).alias("success"), F.try_element_at("e.artifacts", F.lit(1))["row_count"].alias("row_count"),
        F.when(~failed, F.col("e.message")).alias("message"))
