"""Plan shape of every registered query: no row-at-a-time Python
(``BatchEvalPython``), no cartesian product, filters reach the parquet scan,
lookups are joins, scans read only the needed columns."""

import re

import pytest

import __spark_entry__ as E
from tablewright.plans import registry
from conftest import SF_SMALL

NAMES = list(registry.QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_rows_no_cartesian(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_filter_pushed_to_scan(spark):
    p = plan_of(E.queries()["simple_filter_insert"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_mktsegment,BUILDING\)", p)
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in p


def test_lookup_is_join(spark):
    p = plan_of(E.queries()["lookup_overwrite"](spark, SF_SMALL))
    assert "Join" in p and "Subquery" not in p


def test_only_fuzzy_uses_python(spark):
    for name in NAMES:
        p = plan_of(E.queries()[name](spark, SF_SMALL))
        if "ArrowEvalPython" in p or "FlatMapGroupsInPandas" in p:
            assert name in FUZZY, name


FUZZY = ("fuzzy_part_names", "resolve_part_names", "glossary_part_brands", "two_pass_part_columns",
         "segment_match_nations", "match_customer_names", "resolve_customer_names", "two_pass_customer_columns",
         "glossary_customer_names", "segment_customer_names")
