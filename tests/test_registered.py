"""Every registered query runs, and agrees with its SQL on DuckDB."""

import pytest
from check_queries import differ, duck, run_spark, run_sql

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_entry(spark):
    assert entry.entry(spark).count() == 150


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = run_spark(lambda *_: df, spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        assert differ(got, run_sql(con, SQL[name])) in (None, "last digits of doubles differ")
    else:
        assert got[1]
