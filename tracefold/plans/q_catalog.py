"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..schemas import LEVELS, RECORDS
from ..sources import derive
from .oracle_views import with_views
from .registry import register


def _records(spark, sf):
    return derive.load_records(spark, sf).select(*[f.name for f in RECORDS.fields])


def _type_name(dt) -> str:
    return dt.simpleString()


def _report_sql() -> str:
    meta = ", ".join(f"('records', {i + 1}, '{f.name}', '{_type_name(f.dataType)}', {'false' if f.nullable else 'true'})"
                     for i, f in enumerate(RECORDS.fields))
    def mm(f, fn):
        t = f.dataType.simpleString()
        if t in ("string", "boolean", "int", "bigint"):
            return f"CAST({fn}({f.name}) AS VARCHAR)"
        if t == "timestamp":
            return f"strftime({fn}({f.name}), '%Y-%m-%d %H:%M:%S.%f')"
        return "CAST(NULL AS VARCHAR)"

    prof = " UNION ALL ".join(
        f"SELECT '{f.name}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {f.name} IS NULL) AS n_nulls, "
        f"count(DISTINCT {f.name}) AS n_distinct, {mm(f, 'min')} AS min_value, {mm(f, 'max')} AS max_value "
        f"FROM records" for f in RECORDS.fields)
    return f"""
meta(table_name, ordinal, column_name, data_type, not_null) AS (VALUES {meta}),
prof AS ({prof}),
report AS (SELECT m.table_name, m.column_name, m.ordinal, m.data_type, m.not_null, p.n_rows, p.n_nulls, p.n_distinct,
                  p.min_value, p.max_value
           FROM meta m LEFT JOIN prof p ON m.column_name = p.column_name)"""


@register("s3_schema_report", with_views(["records"], f"WITH {_report_sql()} SELECT * FROM report"))
def s3(spark, sf):
    """S3 + L4: columns of the records table with a full-scan profile (exact distinct counts)."""
    rep = C.schema_report(spark, {"records": _records(spark, sf)}, exact=True, declared={"records": RECORDS})
    return rep.select("table_name", "column_name", "ordinal", "data_type", "not_null", "n_rows", "n_nulls", "n_distinct",
                      "min_value", "max_value")


@register("s3_profile_sketches", with_views(["records"], f"""
WITH {_report_sql()}
SELECT column_name, n_rows, n_nulls, min_value, max_value FROM report"""))
def s3_sketches(spark, sf):
    """S3 from sketches of each day, merged: the exact columns (estimates are tested for their error bounds)."""
    days = _records(spark, sf).withColumn("day", F.to_date("start_timestamp"))
    return C.merged_profile(C.profile_sketches(days)).select("column_name", "n_rows", "n_nulls", "min_value", "max_value")


_ENUM_SQL = "CREATE TYPE log_level AS ENUM (" + ", ".join(f"''{v}''" for v in LEVELS) + ");"


@register("s4_schema_text", with_views(["records"], f"""
WITH {_report_sql()}
SELECT 'table' AS kind, table_name AS name,
       'CREATE TABLE ' || table_name || ' (' || chr(10)
       || string_agg('    ' || column_name || ' ' || data_type || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END,
                     ',' || chr(10) ORDER BY ordinal) || chr(10) || ');' AS ddl
FROM report WHERE n_rows > 0 GROUP BY table_name
UNION ALL SELECT 'enum', 'log_level', '{_ENUM_SQL}'"""))
def s4(spark, sf):
    """DDL text of the records table and its level enum (tables with rows)."""
    rep = C.schema_report(spark, {"records": _records(spark, sf)}, exact=False, declared={"records": RECORDS}).where("n_rows > 0")
    return C.schema_text(rep, {"log_level": LEVELS})


_DOMAIN_SQL = "domain(enum_name, value, sort_order) AS (VALUES " + ", ".join(
    f"('log_level', '{v}', {i + 1})" for i, v in enumerate(LEVELS)) + ")"


@register("s5_value_domains", with_views(["records"], f"""
WITH {_DOMAIN_SQL},
counts AS (SELECT level AS value, count(*) AS n_rows FROM records GROUP BY level)
SELECT d.enum_name, coalesce(d.value, c.value) AS value, d.sort_order, coalesce(c.n_rows, 0) AS n_rows
FROM domain d FULL JOIN counts c ON d.value = c.value"""))
def s5(spark, sf):
    """Observed level counts against the declared enum order."""
    return C.value_domains(derive.load_records(spark, sf), "level", C.domain_frame(spark, "log_level", LEVELS))


@register("j1_domain_columns", with_views(["records"], f"""
WITH {_DOMAIN_SQL}, used AS (SELECT DISTINCT level FROM records)
SELECT 'records' AS table_name, 'level' AS column_name, d.enum_name, d.value, d.sort_order
FROM domain d WHERE d.value IN (SELECT level FROM used)"""))
def j1(spark, sf):
    """Enum values joined to the column declared with it (values that occur in the data)."""
    meta = C.column_metadata(spark, {"records": _records(spark, sf)}, {"records": RECORDS})
    dom = C.domain_frame(spark, "log_level", LEVELS)
    used = derive.load_records(spark, sf).select("level").distinct().withColumnRenamed("level", "value")
    return C.domain_columns(meta, dom.join(used, "value", "left_semi"), {("records", "level"): "log_level"})
