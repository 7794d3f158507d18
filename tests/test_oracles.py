"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import rows_of
from rollbook.plans.adapters import GIVEN
from tests.conftest import SMALL

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for g in GIVEN:
        con.execute(f"CREATE VIEW {g} AS SELECT * FROM '{SMALL}/{g}.parquet'")
    return con


def assert_no_nested_loop(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert_no_nested_loop(name, df)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_is_sorted_and_lists_unused_roles(spark):
    rows = entry(spark).collect()
    holders = [r.holders for r in rows]
    assert holders == sorted(holders, reverse=True) and holders[-1] == 0 and rows[-1].role_code == "RO999"
