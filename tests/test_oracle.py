"""Every registered query against its SQL twin (DuckDB over the same Parquet files)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tracefold.plans import registry
from tools.oracle_check import duck, frame_digest, spark_pdf

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_a_twin():
    missing = sorted(set(registry.QUERIES) - set(registry.ORACLE))
    assert missing == []
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, con, name):
    s = spark_pdf(E.queries()[name](spark, SF_SMALL))
    d = con.sql(E.oracle_sql()[name]).df()
    sc, sn, sh, srows = frame_digest(s)
    dc, dn, dh, drows = frame_digest(d)
    assert sc == dc
    assert sn == dn
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["service_name", "hour", "n_errors", "first_seen", "last_seen", "n_exceptions"]
    assert df.count() >= 0
