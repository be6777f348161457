"""The driver's correctness gate, locally: every registered query against its
DuckDB oracle SQL at sf0.01 (row count, column names, order-insensitive value
hash); rows-only queries must run and return rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_check  # noqa: E402
import __spark_entry__ as E
from tablewright.plans import registry  # noqa: E402

from conftest import SF_CHECK  # noqa: E402

NAMES = list(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF_CHECK)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["cust_id", "cust_name"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_CHECK)
    rows = [tuple(r) for r in df.collect()]
    s_cols, s_n, s_h, _ = oracle_check.digest(df.columns, rows)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert s_n > 0
        return
    res = duck.execute(sql)
    o_cols, o_n, o_h, _ = oracle_check.digest([d[0] for d in res.description], res.fetchall())
    assert (s_cols, s_n, s_h) == (o_cols, o_n, o_h)
