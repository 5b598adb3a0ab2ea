"""Every registered query with a SQL oracle matches DuckDB (order-insensitive,
6-decimal values) on the small fixture; the driver repeats this at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_conn

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "ok", r.get("detail")


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "n_rows" in df.columns
