"""Delegated query surface (G7 + §2.12): one guarded statement per query class.

Each statement runs through ``guarded_query`` (parse-only check, then a
structural 1000-row cap) over temp views of the input tables.  Every statement
reads whole tables and returns fewer rows than the cap.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.guard import guarded_query
from ..sources import derive
from ..sources.tables import TABLES, table
from .oracle_views import with_views
from .registry import register


def register_views(spark: SparkSession, sf: str) -> set[str]:
    """Temp views for the input tables and the derived records (metadata only, nothing is read)."""
    for t in TABLES:
        table(spark, sf, t).createOrReplaceTempView(t)
    derive.load_records(spark, sf).createOrReplaceTempView("records")
    return set(TABLES) | {"records"}


def _run(spark, sf, sql, mode="structural"):
    allowed = register_views(spark, sf)
    res = guarded_query(spark, sql, 1000, allowed_tables=allowed, mode=mode)
    if not res.ok:
        raise RuntimeError(res.message)
    return res.df


# name -> (Spark SQL, DuckDB SQL); the same text where the dialects agree
STATEMENTS: dict[str, tuple[str, str]] = {}

STATEMENTS["sql_inner_join"] = ("""
SELECT n.n_name, count(*) AS n_lines, CAST(sum(l.l_quantity) AS BIGINT) AS total_qty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name""", None)

STATEMENTS["sql_left_join"] = ("""
SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS n_customers, count(o.o_orderkey) AS n_orders,
       count(DISTINCT CASE WHEN o.o_orderkey IS NULL THEN c.c_custkey END) AS n_without_orders
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""", None)

STATEMENTS["sql_semi_join"] = ("""
SELECT c.c_nationkey, count(*) AS n_customers
FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
GROUP BY c.c_nationkey""", None)

STATEMENTS["sql_anti_join"] = ("""
SELECT p.p_brand, count(*) AS n_never_ordered
FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 45)
GROUP BY p.p_brand""", None)

STATEMENTS["sql_full_outer_join"] = ("""
SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
ON c.k = s.k""", None)

# A share of the total: the one-row side makes the cross join as small as the other side.
STATEMENTS["sql_share_of_total"] = ("""
SELECT c.c_mktsegment, count(*) AS n, max(t.n) AS n_total
FROM customer c CROSS JOIN (SELECT count(*) AS n FROM customer) t
GROUP BY c.c_mktsegment""", None)

# NOT IN, written so that no side is broadcast whatever its size: no match, and no NULL among the keys.
STATEMENTS["sql_not_in"] = ("""
SELECT p.p_brand, count(*) AS n_not_in
FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 48)
  AND (SELECT count(*) FROM lineitem l WHERE l.l_quantity >= 48 AND l.l_partkey IS NULL) = 0
GROUP BY p.p_brand""", """
SELECT p.p_brand, count(*) AS n_not_in
FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)
GROUP BY p.p_brand""")

STATEMENTS["sql_cube"] = ("""
SELECT l_returnflag, l_linestatus, count(*) AS n_lines
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""", None)

STATEMENTS["sql_grouping_sets"] = ("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n_lines
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())""", None)

# Interval join written for scale: each event is paired only with events of the same user in its own or the
# next minute bucket (an equi-join on (user, bucket)), then the exact 60-second condition is applied, so a
# busy user never compares all of its events with each other.
STATEMENTS["sql_interval_join"] = ("""
WITH e AS (SELECT user_id, event_type, ts, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 60000000) AS BIGINT) AS b
           FROM events),
probe AS (SELECT user_id, event_type, ts, explode(array(b, b + 1)) AS b FROM e)
SELECT concat(p.event_type, '>', l.event_type) AS pair, count(*) AS n_within_minute
FROM probe p JOIN e l ON p.user_id = l.user_id AND p.b = l.b
WHERE l.ts > p.ts AND l.ts <= p.ts + INTERVAL 60 SECONDS
GROUP BY 1""", """
SELECT e1.event_type || '>' || e2.event_type AS pair, count(*) AS n_within_minute
FROM events e1 JOIN events e2 ON e1.user_id = e2.user_id AND e2.ts > e1.ts AND e2.ts <= e1.ts + INTERVAL 60 SECOND
GROUP BY 1""")

STATEMENTS["sql_rollup"] = ("""
SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS total_qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""", None)

STATEMENTS["sql_rank_window"] = ("""
SELECT n_nationkey, s_suppkey, rnk, running_n FROM (
  SELECT s.s_nationkey AS n_nationkey, s.s_suppkey,
         CAST(rank() OVER (PARTITION BY s.s_nationkey ORDER BY s.s_acctbal DESC, s.s_suppkey) AS BIGINT) AS rnk,
         count(*) OVER (PARTITION BY s.s_nationkey ORDER BY s.s_acctbal DESC, s.s_suppkey
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_n
  FROM supplier s) t
WHERE rnk <= 3""", None)

STATEMENTS["sql_top_k"] = ("""
SELECT o.o_custkey, CAST(sum(l.l_quantity) AS BIGINT) AS total_qty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_custkey ORDER BY total_qty DESC, o.o_custkey LIMIT 10""", None)

STATEMENTS["sql_set_ops"] = ("""
SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) a
UNION ALL
SELECT 'customer_only' AS kind, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) b
UNION ALL
SELECT 'any' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) c""", None)

STATEMENTS["sql_correlated_subquery"] = ("""
SELECT o.o_orderstatus, count(*) AS n_above_customer_avg
FROM orders o
WHERE o.o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)
GROUP BY o.o_orderstatus""", None)

STATEMENTS["sql_string_date_json"] = ("""
SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS STRING) AS day, upper(event_type) AS kind,
       count(*) AS n, count(CASE WHEN CAST(get_json_object(props, '$.k') AS INT) > 50 THEN 1 END) AS n_k_over_50,
       CAST(max(length(props)) AS BIGINT) AS max_props_len
FROM events GROUP BY 1, 2""", """
SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, upper(event_type) AS kind,
       count(*) AS n, count(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN 1 END) AS n_k_over_50,
       CAST(max(length(props)) AS BIGINT) AS max_props_len
FROM events GROUP BY 1, 2""")

STATEMENTS["sql_records_example_count"] = ("""
SELECT COUNT(*) AS error_count FROM records
WHERE level = 'error' AND start_timestamp::date > TIMESTAMP '2024-01-15 10:00:00' - INTERVAL '1 day'""", None)

STATEMENTS["sql_smoke_errors"] = ("""
SELECT span_id, level, message FROM records WHERE level = 'error' ORDER BY span_id LIMIT 5""", None)


# The example statements of the chat agent, in Spark SQL spelling (`->>`, `?` and `= ANY` have no Spark
# parse), with a fixed "now" and ORDER BY span_id so that the example's LIMIT 100 is repeatable.
STATEMENTS["sql_example_attr_false"] = ("""
SELECT * FROM records WHERE get_json_object(attributes, '$.foobar') = 'false' ORDER BY span_id LIMIT 100""", """
SELECT * FROM records WHERE json_extract_string(attributes, '$.foobar') = 'false' ORDER BY span_id LIMIT 100""")

STATEMENTS["sql_example_attr_key"] = ("""
SELECT * FROM records WHERE array_contains(json_object_keys(attributes), 'foobar') ORDER BY span_id LIMIT 100""", """
SELECT * FROM records WHERE list_contains(json_keys(attributes), 'foobar') ORDER BY span_id LIMIT 100""")

STATEMENTS["sql_example_yesterday"] = ("""
SELECT * FROM records WHERE start_timestamp::date > TIMESTAMP '2024-01-15 10:00:00' - INTERVAL '1 day'
ORDER BY span_id LIMIT 100""", """
SELECT * FROM records WHERE CAST(start_timestamp AS DATE) > TIMESTAMP '2024-01-15 10:00:00' - INTERVAL 1 DAY
ORDER BY span_id LIMIT 100""")

STATEMENTS["sql_example_error_tag"] = ("""
SELECT * FROM records WHERE level = 'error' AND array_contains(tags, 'rate-limit') ORDER BY span_id LIMIT 100""", """
SELECT * FROM records WHERE level = 'error' AND list_contains(tags, 'rate-limit') ORDER BY span_id LIMIT 100""")


def _make(name, spark_sql, mode="structural"):
    def q(spark, sf):
        return _run(spark, sf, spark_sql, mode)
    q.__doc__ = f"Guarded statement: {name}."
    return q


for _name, (_spark_sql, _duck_sql) in STATEMENTS.items():
    _twin = _duck_sql if _duck_sql is not None else _spark_sql
    if "records" in _twin:
        _twin = with_views(["records"], _twin)
    register(_name, _twin)(_make(_name, _spark_sql))


# The textual mode (the reference's own guard and LIMIT rewrite): the statement gets " LIMIT 1000" appended.
_TEXTUAL = "SELECT level, service_name, count(*) AS n FROM records GROUP BY level, service_name"
register("sql_textual_level_counts", with_views(["records"], _TEXTUAL + " LIMIT 1000"))(
    _make("sql_textual_level_counts", _TEXTUAL, "textual"))
