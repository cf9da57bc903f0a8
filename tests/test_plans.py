"""Scale checks on the physical plans of every registered query (string checks of explain)."""

import pytest

import __spark_entry__ as E
from tracefold.plans import registry
from conftest import SF_SMALL

BAD = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_udf_no_cartesian(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    # one side of this cross join is a single row, which the guard lets pass
    one_row = {"sql_share_of_total": "BroadcastNestedLoopJoin"}
    for bad in BAD:
        assert bad not in text or one_row.get(name) == bad, f"{name}: {bad}"


def test_flagship_pushes_day_range_and_prunes_columns(spark):
    df = E.queries()["flagship_error_rollup"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    # partial aggregation before the shuffle
    assert text.count("HashAggregate") >= 2


def test_run_state_fold_windows_only_per_slice(spark):
    # the fold never windows or joins a whole run: its window is per (run, seq bucket)
    text = plan_text(E.queries()["w10_fold_run_state"](spark, SF_SMALL))
    windows = [ln for ln in text.splitlines() if "Window [" in ln]
    assert windows and all("__slice" in ln.split("],")[-2] for ln in windows)


def test_running_index_is_bucketed(spark):
    # the per-run counter windows over (run, bucket), never over the run alone
    text = plan_text(E.queries()["w3_index_tool_calls"](spark, SF_SMALL))
    assert "__bucket" in text


def test_exact_profile_sends_no_row_once_per_column(spark):
    from tracefold.operators.catalog import profile
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None), (2, "b", [1])], "x long, y string, z array<int>")
    got = profile("t", df, exact=True)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [
        ("t", 3, "x", 0, 2, "1", "2"), ("t", 3, "y", 1, 2, "a", "b"), ("t", 3, "z", 1, 1, None, None)]
    assert sorted(map(tuple, profile("t", df.where("false"), exact=True).collect())) == [("t", 0, c, 0, 0, None, None) for c in "xyz"]


def test_t1_captures_are_not_shuffled(spark):
    from tracefold.plans.registry import QUERIES
    plan = QUERIES["t1_ingest_captures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("turn#" in line for line in exchanges) == 1 and not any("type#" in line for line in exchanges)
