"""Cases that once gave wrong answers."""

import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators import conditional as cond, diff, filters, fuzzy, joins, mutate, quality
from tablewright.plans import engine_queries as eq, registry, runs
from tests.conftest import SF_SMALL


def test_resolve_names_without_order(spark):
    mentions = spark.createDataFrame([("MAR",)], "m string")
    names = spark.createDataFrame([("MARA", 1), ("MARC", 2)], "t string, o int")
    plain = fuzzy.resolve_names(mentions, "m", names, "t", 0.4).first()
    ordered = fuzzy.resolve_names(mentions, "m", names, "t", 0.4, dict_order="o").first()
    assert tuple(plain) == tuple(ordered) and plain.confidence == 0.5


def test_orders_above_2_to_the_53(spark):
    left = spark.createDataFrame([("MAR",)], "m string")
    right = spark.createDataFrame([("MARA", 2**53 + 1), ("MARC", 2**53)], "t string, o long")
    got = {r.match: r.match_order for r in fuzzy.fuzzy_matches(left, "m", right, "t", 0.4, "o").collect()}
    assert got == {"MARA": 2**53 + 1, "MARC": 2**53}


def test_keyed_diff_null_and_repeated_keys(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {tuple(r) for r in diff.diff_keyed(a, b, ["k"]).collect()} == {(None, "removed"), (2, "new")}
    a = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert [tuple(r) for r in diff.diff_keyed(a, b, ["k"]).collect()] == [(1, "changed")]
    assert diff.diff_keyed(a, a, ["k"]).count() == 0 and diff.diff_keyed(a, a, ["k"], null_equal=False).count() == 1
    new, removed = diff.diff_rows(a.unionByName(a), b)
    assert new.count() == 0 and [tuple(r) for r in removed.collect()] == [(1, None)] * 2


def test_one_pick_rule_and_null_orders(spark):
    src = spark.createDataFrame([(1, None, "B"), (1, "x", "A")], "k int, c string, e string")
    t = spark.createDataFrame([(1, "old", "old")], "k int, c string, e string")
    assert mutate.update_from(t, src, "k", {"c": "c"}).first().c == "x"
    both = mutate.update_from(t, src, "k", {"c": "c", "e": "e"}).first()
    assert (both.c, both.e) == ("x", "A")
    one = spark.createDataFrame([(1, "new", None)], "k int, c string, o int")
    assert mutate.update_from(t, one, "k", {"c": "c"}, order="o").first().c == "new"
    two = spark.createDataFrame([(1, "late", None), (1, "first", 1)], "k int, c string, o int")
    assert mutate.update_from(t, two, "k", {"c": "c"}, order="o").first().c == "first"
    assert mutate.update_from(t, two, "k", {"c": "c"}, order="o", pick="max").first().c == "first"


def test_composite_join_keys(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "m int, w int")
    on = [joins.JoinCondition("a", "b", c, c) for c in ("m", "w")]
    assert joins.join_tables_spec({"a": a, "b": a}, on).count() == 2
    with pytest.raises(ValueError):
        joins.join_tables_spec({"a": a, "b": a, "c": a}, [joins.JoinCondition("b", "c", "m", "m")])


@pytest.mark.parametrize("n", [1, 999, 1001, 1500])
def test_listed_values_have_one_semantics(spark, n):
    df = spark.createDataFrame([(0,), (2000,), (9999,), (None,)], "v int")
    out = cond.map_in_lists(df, "v", [(range(n), 1), ([2000], None)], 7, "g")
    assert out.schema["g"].dataType.simpleString() == "int" and [r.g for r in out.collect()] == [1, None, 7, 7]
    assert [r.g for r in cond.map_in_lists(df, "v", [(range(n), F.col("v") + 5)], F.lit(0), "g").collect()] == [5, 0, 0, 0]


def test_dirty_text_never_raises(spark):
    src = spark.createDataFrame([("abc", "1"), ("7", "x")], "a string, s string")
    t = spark.createDataFrame([], "n long")
    assert sorted(str(r.n) for r in mutate.insert_select(t, src, {"n": "a"}).collect()) == ["7", "None"]
    assert filters.where(src, {"s": 1}).count() == 1 and filters.where(src, {"s": [1, 2]}).count() == 1
    assert [r.f for r in mutate.set_if(src, "s", 1, "f", "y", "n").collect()] == ["y", "n"]
    got = quality.validate(src, [quality.Rule("a", "range", {"min": 1, "max": 9})]).collect()
    assert len(got) == 2


def test_snapshot_after_a_broken_write(spark, scratch):
    path = os.path.join(scratch, "snap")
    os.makedirs(os.path.join(path, "_temporary", "0"))
    assert runs.ensure_snapshot(spark.range(3), path).count() == 3
    assert runs.ensure_snapshot(spark.range(9), path).count() == 3


def test_finished_runs_keep_only_the_last_version(spark, scratch):
    out = runs.run_steps(spark, "r", eq._steps(), eq._target(spark), eq._sources(spark, SF_SMALL), run_dir=scratch)
    left = sorted(f for f in os.listdir(os.path.join(scratch, out.attempt)) if f.startswith("step_"))
    assert left == ["step_003"] and out.target.count() >= 0


def test_every_class_and_reason_occurs(spark):
    for name, column, values in (
            ("sql_kind_target", "statement_kind", {s[1] for s in eq.STATEMENTS}), ("sql_transform_type", "transformation_type", {s[3] for s in eq.STATEMENTS}),
            ("sql_sync_decision", "sync_reason", {s[4] for s in eq.STATEMENTS}), ("classify_requests", "query_type", {r[1] for r in eq.REQUESTS})):
        got = {r[column] for r in registry.QUERIES[name](spark, SF_SMALL).select(column).distinct().collect()}
        assert got == values and len(values) >= 5
