"""The structural guard (G7/G8): parse-only checks before anything runs, and the structural cap."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from tracefold.operators.guard import check_analysed, check_statement, guarded_query


@pytest.fixture(scope="module")
def views(spark):
    spark.range(3000).selectExpr("id", "id % 7 AS k").createOrReplaceTempView("t")
    return {"t"}


@pytest.mark.parametrize("sql", [
    "SELECT * FROM t",
    "WITH a AS (SELECT k FROM t) SELECT count(*) AS n FROM a",
    "SELECT k, count(*) FROM t GROUP BY k ORDER BY k",
    "SELECT * FROM t a JOIN t b ON a.id = b.id WHERE a.k = 1",
    "SELECT 'please update the docs' AS note FROM t",
    "SELECT k FROM t UNION SELECT k FROM t",
    "SELECT id, rank() OVER (PARTITION BY k ORDER BY id) FROM t",
    "SELECT /*+ REPARTITION(4) */ * FROM t",
    "SELECT id AS CommandLine, k AS DropTableName FROM t",
    "WITH a AS (SELECT k FROM t WHERE k IN (SELECT k FROM t WHERE id < 5)) SELECT count(*) FROM a",
])
def test_accepts_read_only(spark, views, sql):
    assert check_statement(spark, sql, views) is None


@pytest.mark.parametrize("sql", [
    "DROP TABLE t",
    "INSERT INTO t SELECT 1, 2",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t",
    "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT * FROM parquet.`/etc`",
    "SELECT * FROM other_table",
    "SELECT 1; SELECT 2",
    "CACHE TABLE t",
    "SELECT /*+ BROADCAST(b) */ * FROM t a JOIN t b ON a.id = b.id",
    "SELECT /*+ MAPJOIN(b) */ * FROM t a JOIN t b ON a.id = b.id",
    "SET spark.sql.shuffle.partitions=1",
])
def test_rejects(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views)
    assert not res.ok and res.df is None
    env = json.loads(res.envelope())
    assert env["type"] == "tool_result" and env["version"] == 1 and env["data"] == {"success": False}


def test_nothing_executes_on_reject(spark, views):
    guarded_query(spark, "DROP TABLE t", allowed_tables=views)
    assert spark.table("t").count() == 3000


def test_structural_cap(spark, views):
    res = guarded_query(spark, "SELECT * FROM t LIMIT 5000", 1000, allowed_tables=views)
    assert res.ok and res.df.count() == 1000
    res = guarded_query(spark, "SELECT * FROM t WHERE k = 3 -- comment", 1000, allowed_tables=views)
    assert res.ok and res.df.count() == sum(1 for i in range(3000) if i % 7 == 3)
    env = json.loads(res.envelope([{"id": "a_run_1", "type": "table", "row_count": 429}]))
    assert "data" not in env and env["artifacts"][0]["row_count"] == 429


@settings(max_examples=25, deadline=None)
@given(n=st.integers(min_value=0, max_value=5000), cap=st.integers(min_value=1, max_value=2000),
       inner=st.booleans())
def test_property_never_more_than_cap(spark, views, n, cap, inner):
    sql = f"SELECT * FROM (SELECT * FROM t LIMIT {n}) x" if inner else f"SELECT * FROM t LIMIT {n}"
    res = guarded_query(spark, sql, cap, allowed_tables=views)
    assert res.ok
    assert res.df.count() == min(n, cap, 3000)


@pytest.mark.parametrize("sql", [
    "SELECT * FROM t a, t b",
    "SELECT * FROM t a JOIN t b ON a.id < b.id",
    "SELECT * FROM t a CROSS JOIN t b",
])
def test_rejects_all_pairs(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views)
    assert not res.ok and "all pairs" in res.message
    assert guarded_query(spark, sql, 1000, allowed_tables=views, allow_pairwise=True).ok


def test_textual_mode_reproduces_the_reference_rules(spark, views):
    def run(sql):
        return guarded_query(spark, sql, 1000, allowed_tables=views, mode="textual")

    assert run("SELECT * FROM t").df.count() == 1000                       # LIMIT appended
    assert run("SELECT * FROM t LIMIT 5000").df.count() == 1000            # first LIMIT too large: rewritten
    assert run("SELECT * FROM (SELECT * FROM t LIMIT 10) x LIMIT 5000").df.count() == 10
    assert run("SELECT * FROM t -- note").df.count() == 3000               # the comment swallows the LIMIT
    assert run("SELECT * FROM t WHERE 'rate-limit' <> ''").df.count() == 3000  # 'limit' letters: no cap
    bad = run("SELECT 'Failed to update' AS x FROM t")
    assert not bad.ok and bad.message == "Error: UPDATE statements are not allowed for safety reasons."
    assert run("WITH a AS (SELECT 1) SELECT * FROM a").message == "Error: Only SELECT queries are allowed for safety."


@pytest.mark.parametrize("sql", [
    "SELECT REFLECT('java.lang.System', 'getProperty', 'java.home')",
    "SELECT `Reflect`('java.lang.System', 'getProperty', 'java.home')",
    "SELECT " + ", ".join(f"id AS c{i}" for i in range(40)) + ", java_method('java.util.UUID', 'randomUUID') FROM t",
    "SELECT * FROM t WHERE k IN (SELECT try_reflect('java.lang.System', 'exit', 0))",
    "WITH a AS (SELECT reflect('java.lang.System', 'exit', 0) AS x) SELECT * FROM a",
    "SELECT k, (SELECT max(reflect('java.lang.System', 'exit', 0)) FROM t) FROM t",
    "SELECT system.builtin.reflect('java.lang.System', 'exit', 0)",
    "SELECT * FROM t ORDER BY reflect('java.lang.System', 'exit', 0)",
    "SELECT k FROM t GROUP BY k HAVING max(java_method('java.util.UUID', 'randomUUID')) IS NULL",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'exit', 0))",
    "SELECT input_file_name() FROM t",
    "SELECT some_database.some_function(id) FROM t",
    "SELECT * FROM t JOIN LATERAL (SELECT reflect('java.lang.System', 'exit', 0)) x",
    "SELECT * FROM python_worker_logs()",
])
def test_functions_are_checked_everywhere(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views)
    assert not res.ok and "not allowed" in res.message, res.message


def test_a_registered_function_does_not_pass_as_a_builtin(spark):
    other = spark.newSession()
    other.udf.register("soundex", lambda x: x)  # shadows a built-in name in this session
    assert "soundex is not allowed" in guarded_query(other, "SELECT soundex('a')", allowed_tables=set()).message
    assert guarded_query(spark, "SELECT soundex('a')", allowed_tables=set()).ok


@pytest.mark.parametrize("sql", [
    "SELECT 'reflect(' AS x, 'java_method(' AS y FROM t",
    "SELECT 'UnresolvedRelation [other]' AS x FROM t",
    "SELECT upper('a'), typeof(1), approx_count_distinct(id) FROM t",
    "SELECT * FROM range(5)",
    "SELECT k, count(*) / (SELECT count(*) FROM t) AS share FROM t GROUP BY k",
    "SELECT t.k, n FROM t CROSS JOIN (SELECT count(*) AS n FROM t)",
    "SELECT k FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.id = t.k)",
])
def test_harmless_statements_are_not_refused(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views)
    assert res.ok, res.message
    res.df.count()


def test_a_cte_name_holds_in_its_own_scope_only(spark, views):
    spark.range(3).createOrReplaceTempView("secret")
    sql = "SELECT * FROM secret WHERE id IN (WITH secret AS (SELECT k FROM t) SELECT k FROM secret)"
    assert "secret is not available" in check_statement(spark, sql, views)
    assert check_statement(spark, "WITH secret AS (SELECT k FROM t) SELECT * FROM secret", views) is None
    assert "b is not available" in check_statement(spark, "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", views)
    assert check_statement(spark, "WITH b AS (SELECT 1 x), a AS (SELECT * FROM b) SELECT * FROM a", views) is None
    assert "recursive" in check_statement(spark, "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", views)


def test_not_in_is_refused_whatever_the_size(spark, views):
    res = guarded_query(spark, "SELECT * FROM t WHERE k NOT IN (SELECT CASE WHEN id > 5 THEN id END FROM t)", allowed_tables=views)
    assert not res.ok and "NOT EXISTS" in res.message


def test_unicode_blanks_are_blanks(spark, views):
    res = guarded_query(spark, "\u3000SELECT * FROM t\u3000", 10, allowed_tables=views, mode="textual")
    assert res.message == "Query planned." or "does not parse" in res.message
    from pyspark.sql import functions as F

    from tracefold.operators.guard import capped_text, is_select
    row = spark.createDataFrame([("\u3000SELECT 1\u3000; \u2003",)], "sql string").select(
        is_select(F.col("sql")).alias("s"), capped_text(F.col("sql"), 7).alias("c")).first()
    assert row.s and row.c == "\u3000SELECT 1\u3000 LIMIT 7"


HIDDEN = [
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.home') FROM t",
    "SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'java.home') FROM t",
    "SELECT id FROM t WHERE IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'java.home') = 'x'",
    "SELECT id FROM t WHERE k IN (SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'java.home') FROM t)",
    "SELECT (SELECT max(IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.home')) FROM t) AS x FROM t",
    "SELECT count(*) FROM t GROUP BY IDENTIFIER('try_' || 'reflect')('java.lang.System', 'getProperty', 'java.home')",
    "SELECT id FROM t ORDER BY IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.home')",
    "SELECT IDENTIFIER('input_file_name')() FROM t",
]


@pytest.mark.parametrize("mode", ["structural", "textual"])
@pytest.mark.parametrize("sql", HIDDEN)
def test_no_spelling_of_a_function_passes(spark, views, sql, mode):
    res = guarded_query(spark, sql, 1000, allowed_tables=views, mode=mode)
    assert not res.ok and res.df is None and "not allowed" in res.message


@pytest.mark.parametrize("sql", [*HIDDEN, "WITH a AS (SELECT reflect('java.lang.System', 'getProperty', 'java.home') AS x FROM t) SELECT * FROM a",
                                 "SELECT * FROM t JOIN LATERAL (SELECT java_method('java.util.UUID', 'randomUUID')) x",
                                 "SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'java.home')) FROM t"])
def test_the_analysed_plan_alone_refuses_them(spark, views, sql):
    try:
        df = spark.sql(sql)
    except AnalysisException:
        return  # Spark itself refuses some: reflection counts as non-deterministic
    assert "not allowed" in check_analysed(spark, df)


def test_user_functions_are_refused_in_the_analysed_plan(spark, views):
    spark.udf.register("shout", lambda x: str(x).upper())
    try:
        assert "PythonUDF" in check_analysed(spark, spark.sql("SELECT shout(id) FROM t"))
        spark.sql("SELECT shout(id) AS s FROM t").createOrReplaceTempView("shouted")
        assert check_analysed(spark, spark.sql("SELECT s FROM shouted WHERE s <> ''")) is None  # a registered view may use them
    finally:
        spark.sql("DROP TEMPORARY FUNCTION shout")
        spark.catalog.dropTempView("shouted")


@pytest.mark.parametrize("sql", [
    "SELECT k, grouping_id(), collect_list(id), count(DISTINCT id) FILTER (WHERE id > 5), listagg(CAST(id AS STRING), ',') FROM t GROUP BY CUBE (k)",
    "SELECT k, sum(id) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lag(id) OVER (ORDER BY id) FROM t",
    "SELECT transform(array(id), x -> x + 1), aggregate(array(id, 2), 0L, (s, x) -> s + x), map('a', id)['a'], named_struct('z', id).z FROM t",
    "SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY, extract(HOUR FROM TIMESTAMP '2024-01-01'), date_trunc('day', current_timestamp()), id BETWEEN 1 AND 2 FROM t",
    "SELECT try_cast('x' AS INT), id::string, try_parse_json('{}'), get_json_object('{}', '$.a'), from_json('{}', 'a INT').a, ceil(id), lpad('a', 3, 'b'), to_char(id, '999') FROM t",
    "SELECT id FROM t WHERE current_timestamp()::date > TIMESTAMP '2024-01-15 10:00:00' - INTERVAL '1 day' AND DATE '2024-01-02' - INTERVAL 1 MONTH < now()",
    "SELECT * FROM t PIVOT (count(*) FOR k IN (0, 1))",
    "SELECT id, y FROM t LATERAL VIEW explode(array(k)) z AS y",
    "SELECT window(TIMESTAMP '2024-01-01', '1 hour').start, percentile_approx(id, 0.5), approx_count_distinct(k) FROM t GROUP BY ALL",
    "SELECT id FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.id = a.id) AND k = (SELECT max(k) FROM t)",
    "SELECT * FROM VALUES (1, 'a') AS v(x, y) UNION ALL SELECT id, 'b' FROM t",
    "SELECT left('abc', 2), url_encode('a b'), regexp_extract('a1', '[0-9]', 0), startswith('ab', 'a'), luhn_check('12'), typeof(id), uuid() FROM t",
])
def test_ordinary_statements_pass_the_analysed_check(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views)
    assert res.ok, res.message


@pytest.mark.parametrize("sql", ["SELECT * FROM t a CROSS JOIN t b", "SELECT * FROM t a, t b LIMIT 10", "SELECT * FROM t a JOIN t b ON a.id < b.id",
                                 "SELECT * FROM t WHERE id NOT IN (SELECT CASE WHEN k > 0 THEN k END FROM t)"])
def test_textual_mode_refuses_all_pairs_too(spark, views, sql):
    res = guarded_query(spark, sql, 1000, allowed_tables=views, mode="textual")
    assert not res.ok and ("all pairs" in res.message or "NOT IN" in res.message)
