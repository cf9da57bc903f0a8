"""The three tool calls end to end: run a statement, preview the schema, export CSV."""

import json
import os
import re

import pytest

from conftest import SF_SMALL
from tracefold import api
from tracefold.plans.q_delegated import register_views
from tracefold.sources import artifacts as store


def test_execute_preview_export(spark, scratch):
    register_views(spark, SF_SMALL)
    env = json.loads(api.execute_sql(spark, "run-1", "SELECT level, count(*) AS n FROM records GROUP BY level",
                                     scratch))
    first = env["artifacts"][0]
    assert env["type"] == "tool_result" and re.fullmatch("a_run-1_[0-9a-f]{8}", first["id"])
    assert first["row_count"] == 5 and "data" not in env

    capped = json.loads(api.execute_sql(spark, "run-1", "SELECT * FROM records", scratch, max_rows=100))
    assert capped["artifacts"][0]["row_count"] == 100 and "capped" in capped["message"]

    bad = json.loads(api.execute_sql(spark, "run-1", "DROP TABLE records", scratch))
    assert bad["data"] == {"success": False} and "artifacts" not in bad

    out = os.path.join(scratch, "export.csv")
    ok = json.loads(api.export_csv(spark, scratch, "run-1", first["id"], out))
    assert ok["data"]["path"] == out
    lines = [ln for f in sorted(os.listdir(out)) if f.endswith(".csv")
             for ln in open(os.path.join(out, f), encoding="utf-8").read().splitlines()]
    assert lines[0] == "level,n" and len(lines) == 6

    missing = json.loads(api.export_csv(spark, scratch, "run-2", first["id"], os.path.join(scratch, "x.csv")))
    assert missing["data"] == {"success": False}


def test_a_cut_off_result_says_so(spark, scratch):
    spark.range(5000).createOrReplaceTempView("five_thousand")
    sql = "SELECT id FROM five_thousand ORDER BY id"
    env = json.loads(api.execute_sql(spark, "run-9", sql, scratch))
    assert env["artifacts"][0]["row_count"] == 1000
    row = store.read_manifest(spark, scratch).where("run_id = 'run-9'").first()
    assert (row.row_count, row.was_capped) == (1000, True)
    kept = store.read_artifact(spark, scratch, "run-9", row.artifact_id)
    assert kept.columns == ["id"] and sorted(r.id for r in kept.collect()) == list(range(1000))
    shown = store.artifact_data(spark, scratch, "run-9", row.artifact_id, n=7)["preview"]
    assert [r.id for r in shown.collect()] == list(range(7))
    whole = json.loads(api.execute_sql(spark, "run-9", sql, scratch, max_rows=5000))
    row = store.read_manifest(spark, scratch).where(f"artifact_id = '{whole['artifacts'][0]['id']}'").first()
    assert (row.row_count, row.was_capped) == (5000, False)


@pytest.mark.parametrize("sql, rows, cut", [
    ("SELECT id FROM five_thousand", 1000, True),                             # the cap goes into the text
    ("SELECT id FROM five_thousand WHERE 'no limit' <> ''", 1000, True),      # no cap in the text
    ("SELECT id FROM five_thousand -- all", 1000, True),                      # the comment swallows it
    ("SELECT id FROM five_thousand LIMIT 3000", 1000, True),
    ("SELECT id FROM five_thousand WHERE id < 1000", 1000, False),
    ("SELECT id FROM (SELECT id FROM five_thousand LIMIT 10) x LIMIT 4000", 10, False),
    ("SELECT id FROM (SELECT id FROM five_thousand LIMIT 4000) x LIMIT 10", 1000, False),  # every LIMIT is rewritten
])
def test_a_cut_off_result_says_so_in_textual_mode(spark, scratch, sql, rows, cut):
    spark.range(5000).createOrReplaceTempView("five_thousand")
    env = json.loads(api.execute_sql(spark, "run-9", sql, scratch, mode="textual"))
    assert env["artifacts"][0]["row_count"] == rows and ("capped" in env["message"]) == cut
    row = store.read_manifest(spark, scratch).first()
    assert (row.row_count, row.was_capped) == (rows, cut)
    assert store.read_artifact(spark, scratch, "run-9", row.artifact_id).count() == rows


def test_run_ids_stay_below_the_root_and_errors_are_not_an_empty_manifest(spark, scratch):
    for bad in ("../x", "a/b", "..", ".hidden", "a b"):
        env = json.loads(api.execute_sql(spark, bad, "SELECT 1 AS x", scratch, allowed_tables=set()))
        assert env["data"] == {"success": False} and "cannot name a folder" in env["message"]
    assert store.read_manifest(spark, scratch).count() == 0
    os.makedirs(os.path.join(scratch, "_manifest", "run_id=r"))
    with open(os.path.join(scratch, "_manifest", "run_id=r", "part-0.parquet"), "w") as f:
        f.write("damaged")
    with pytest.raises(Exception, match="(?i)parquet"):
        store.read_manifest(spark, scratch).count()


def test_preview_schema(spark):
    register_views(spark, SF_SMALL)
    rec = spark.table("records")
    text = json.loads(api.preview_schema(spark, {"records": rec}))["message"]
    assert text.startswith("Database Schema:\nEnum Types:\nCREATE TYPE log_level AS ENUM ('debug', 'info',")
    assert "CREATE TABLE records (\n    created_at timestamp," in text
    assert json.loads(api.preview_schema(spark, {}))["message"] == "Database Schema:\n(no tables found)"
