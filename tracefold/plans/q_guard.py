"""Registered statement-audit queries (G1-G6) over the statement log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guard as G
from ..schemas import FORBIDDEN_KEYWORDS
from ..sources import derive
from .oracle_views import with_views
from .registry import register

_KW_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(upper(sql), '\\b{k}\\b', 'i') THEN '{k}'" for k in FORBIDDEN_KEYWORDS) + " END"
_TRIMMED = "regexp_replace(sql, '^\\s+|\\s+$', '', 'g')"
_SELECT_SQL = f"starts_with(upper({_TRIMMED}), 'SELECT')"
_FIRST = f"regexp_extract(upper({_TRIMMED}), 'LIMIT\\s+(\\d+)', 1)"
_CAP_SQL = f"""CASE WHEN NOT contains(upper({_TRIMMED}), 'LIMIT')
                    THEN regexp_replace(regexp_replace(sql, '\\s+$', ''), ';+$', '') || ' LIMIT 1000'
                    WHEN {_FIRST} <> '' AND (length({_FIRST}) > 18 OR TRY_CAST({_FIRST} AS BIGINT) > 1000)
                    THEN regexp_replace(sql, 'LIMIT\\s+\\d+', 'LIMIT 1000', 'gi')
                    ELSE sql END"""
_AUDIT_SQL = f"""
SELECT stmt_id, run_id, sql,
       CASE WHEN kw IS NOT NULL THEN 'forbidden' WHEN NOT sel THEN 'not_select' ELSE 'allowed' END AS verdict,
       kw AS keyword,
       CASE WHEN kw IS NOT NULL THEN 'Error: ' || kw || ' statements are not allowed for safety reasons.'
            WHEN NOT sel THEN 'Error: Only SELECT queries are allowed for safety.' END AS reason,
       CASE WHEN kw IS NULL AND sel THEN capped END AS final_sql
FROM (SELECT *, {_KW_SQL} AS kw, {_SELECT_SQL} AS sel, {_CAP_SQL} AS capped FROM statements)"""


def _stmts(spark, sf):
    return derive.statements(spark, sf)


# Blanks around a statement and inside its LIMIT; Unicode ones and the four separators count as blanks.
_BLANKS = [" ", "\u00a0", "\u2003\n", "\u3000", "\x1c", "\t\x85", "\u202f\u205f", "\u200b"]  # the last one is none
_CLASS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _blank_sql(shift: int) -> str:
    return "[" + ", ".join(f"'{b}'" for b in _BLANKS) + f"][CAST((stmt_id + {shift}) % {len(_BLANKS)} + 1 AS INTEGER)]"


@register("g1_audit_keywords", with_views(["statements"], f"SELECT stmt_id, {_KW_SQL} AS first_forbidden FROM statements"))
def g1(spark, sf):
    """G1: first forbidden keyword per statement (list order, whole word)."""
    return G.audit_keywords(_stmts(spark, sf)).select("stmt_id", "first_forbidden")


@register("g2_select_only", with_views(["statements"], f"SELECT stmt_id, {_SELECT_SQL} AS is_select FROM statements"))
def g2(spark, sf):
    """Trimmed text starts with SELECT."""
    return G.audit_select_only(_stmts(spark, sf)).select("stmt_id", "is_select")


@register("g3_cap_limit_text", with_views(["statements"], f"SELECT stmt_id, {_CAP_SQL} AS capped_sql FROM statements"))
def g3(spark, sf):
    """Textual row cap (append / compare first / rewrite all)."""
    return G.cap_limit_text(_stmts(spark, sf), 1000).select("stmt_id", "capped_sql")


@register("g4_output_rules", with_views(["statements"], f"""
SELECT stmt_id,
       CASE WHEN NOT starts_with(upper({_TRIMMED}), 'SELECT') THEN 'retry_select'
            WHEN NOT (contains(upper({_TRIMMED}), 'LIMIT') OR contains(upper({_TRIMMED}), 'COUNT')
                      OR contains(upper({_TRIMMED}), 'SUM')) THEN 'retry_limit'
            ELSE 'ok' END AS output_verdict,
       replace(sql, '\\', '') AS clean_sql
FROM statements"""))
def g4(spark, sf):
    """Output validator rules."""
    return G.audit_output_rules(_stmts(spark, sf)).select("stmt_id", "output_verdict", "clean_sql")


@register("g5_audit_statements", with_views(["statements"], f"""
SELECT stmt_id, verdict, keyword, reason, final_sql FROM ({_AUDIT_SQL})"""))
def g5(spark, sf):
    """Keyword guard -> SELECT-only -> cap, per statement."""
    return G.audit_statements(_stmts(spark, sf), 1000).select("stmt_id", "verdict", "keyword", "reason", "final_sql")


@register("g5_audit_unicode_blanks", with_views(["statements"], f"""
, blank AS (
  SELECT stmt_id, run_id, {_blank_sql(0)} || replace(replace(sql, 'LIMIT ', 'LIMIT' || {_blank_sql(3)}), 'limit ', 'limit' || {_blank_sql(3)})
    || {_blank_sql(5)} AS sql FROM statements)
SELECT stmt_id, verdict, keyword, reason, final_sql FROM ({{audit}})""".replace(", blank AS", "WITH blank AS", 1).replace(
    "{audit}", _AUDIT_SQL.replace("FROM statements", "FROM blank").replace("\\s", _CLASS))))
def g5_unicode(spark, sf):
    """G2, G3 and G5 on statements with all sorts of blanks around them and before their limits."""
    def blank(shift: int):
        return F.element_at(F.array(*map(F.lit, _BLANKS)), ((F.col("stmt_id") + shift) % len(_BLANKS) + 1).cast("int"))
    spaced = F.replace(F.replace(F.col("sql"), F.lit("LIMIT "), F.concat(F.lit("LIMIT"), blank(3))), F.lit("limit "), F.concat(F.lit("limit"), blank(3)))
    stmts = _stmts(spark, sf).withColumn("sql", F.concat(blank(0), spaced, blank(5)))
    return G.audit_statements(stmts, 1000).select("stmt_id", "verdict", "keyword", "reason", "final_sql")


@register("g6_audit_summary", with_views(["statements"], f"""
SELECT verdict, keyword, count(*) AS n_statements, count(DISTINCT run_id) AS n_runs,
       count(*) FILTER (WHERE final_sql <> sql) AS n_rewritten
FROM ({_AUDIT_SQL}) GROUP BY verdict, keyword"""))
def g6(spark, sf):
    """Fleet view of the audit."""
    return G.audit_summary(G.audit_statements(_stmts(spark, sf), 1000))
