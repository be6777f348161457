"""Operators on small in-test tables holding the FIXTURES.md edge rows:
NULL and blank keys, repeated keys (same and different values), keys absent
from the lookup, lookup keys with a NULL value.  One named test per SURVEY
1.1 rule where it applies (S1-S4, S14, S16)."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggs, conditional as cond, diff, filters, joins, mutate, quality


@pytest.fixture()
def target(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0), (None, "n", 0.0), (5, "", 50.0)],
        "k int, name string, val double")


@pytest.fixture()
def lookup(spark):
    # key 1 twice with different values, key 2 with a NULL value, key 3 absent, key 4 extra
    return spark.createDataFrame([(1, "x1"), (1, "x0"), (2, None), (4, "x4"), (None, "xn")], "lk int, v string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_s1_lookup_overwrites_unmatched_with_null(target, lookup):
    out = mutate.lookup(target, lookup, ("k", "lk"), "v", "name")
    assert dict((r.k, r.name) for r in out.collect()) == {1: "x0", 2: None, 3: None, None: None, 5: None}
    assert out.count() == target.count()


def test_s2_update_from_keeps_unmatched_and_matched_null_overwrites(target, lookup):
    out = mutate.update_from(target, lookup, ("k", "lk"), {"name": "v"})
    got = dict((r.k, r.name) for r in out.collect())
    assert got[1] == "x0"          # S3: deterministic smallest of the duplicates
    assert got[2] is None          # matched NULL overwrites
    assert got[3] == "c" and got[5] == "" and got[None] == "n"   # unmatched kept
    assert out.count() == target.count()


def test_s3_update_from_with_order(spark, target):
    src = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, ver int")
    out = mutate.update_from(target, src, "k", {"name": "v"}, order="ver", pick="max")
    assert dict((r.k, r.name) for r in out.collect())[1] == "new"


def test_s4_prefix_update_case_insensitive(spark):
    df = spark.createDataFrame([("ECOnomy",), ("eco",), ("Economy",), ("other",), (None,), ("e%co",)], "t string")
    out = mutate.update_where_prefix(df, "t", "eco", "ECO")
    assert sorted([r.t for r in out.collect()], key=str) == sorted(["ECO", "ECO", "ECO", "other", None, "e%co"],
                                                                   key=str)


def test_s16_insert_select_appends_with_nulls(spark, target):
    src = spark.createDataFrame([(9, "z", "BUILDING"), (8, "y", "OTHER")], "id int, nm string, seg string")
    out = mutate.insert_select(target, src, {"k": "id", "extra": F.upper("nm")}, {"seg": "BUILDING"})
    assert out.columns == ["k", "name", "val", "extra"]
    assert out.count() == 6
    new = out.where(F.col("k") == 9).first()
    assert new.name is None and new.val is None and new.extra == "Z"


def test_apply_mapping_modes(spark, target):
    empty = target.limit(0)
    assert mutate.upsert_mode(empty) == "insert"
    assert mutate.upsert_mode(target) == "update"
    assert mutate.upsert_mode(target, "insert") == "insert"


def test_add_drop_column_errors(target):
    with pytest.raises(mutate.ColumnExists):
        mutate.add_column(target, "name")
    with pytest.raises(ValueError):
        mutate.drop_column(target, "missing")
    assert "note" in mutate.add_column(target, "note").columns


def test_delete_where_null_predicate_kept(target):
    out = mutate.delete_where(target, F.col("k") > 2)
    assert sorted([r.k for r in out.collect()], key=lambda x: (x is not None, x)) == [None, 1, 2]


def test_set_if_null_goes_to_else(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",)], "c string")
    out = mutate.set_if(df, "c", "A", "f", "yes", "no")
    assert [r.f for r in out.collect()] == ["yes", "no", "no"]


def test_meta_add_remove(spark):
    meta = spark.createDataFrame([(7, "MATNR", "material", "True", "True", "MARA", None, 1, 2, 3)],
                                 "field_id long, fields string, description string, isMandatory string, isKey string,"
                                 " source_table string, sap_structure string, obj_id_id long, segement_id_id long,"
                                 " project_id_id long")
    added = mutate.meta_add(meta, "MTART", "type", obj_id=1, segment_id=2, project_id=3)
    assert rows(added, "field_id", "fields", "isMandatory") == [(7, "MATNR", "True"), (8, "MTART", "False")]
    removed = mutate.meta_remove(added, "MATNR", obj_id=1, segment_id=2, project_id=3)
    assert [r.fields for r in removed.collect()] == ["MTART"]


def test_condition_map(spark, target):
    out = filters.where(target, {"k": [1, 2, 7], "name": "a", "val": None})
    assert rows(out, "k") == [(1,)]
    assert filters.where(target, {}).count() == 5
    assert filters.match_columns(["custkey", "zzz"], ["c_custkey", "c_name"]) == {"custkey": "c_custkey", "zzz": None}


def test_filter_rows_ops(target):
    assert filters.filter_rows(target, "name", "contains", "a").count() == 1
    assert filters.filter_rows(target, "k", "is_null").count() == 1
    assert filters.filter_rows(target, "k", "ge", 3).count() == 2
    with pytest.raises(ValueError):
        filters.filter_rows(target, "k", "between", 1)


def test_map_in_lists_and_large_lists(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(None,)], "x int")
    small = cond.map_in_lists(df, "x", [([1, 2], "A"), ([2, 3], "B")], "Z", "m")
    got = dict((r.x, r.m) for r in small.collect())
    assert got[1] == "A" and got[2] == "A" and got[3] == "B" and got[4] == "Z" and got[None] == "Z"
    big = cond.map_in_lists(df, "x", [(list(range(0, 1500)), "LOW"), (list(range(1000, 1800)), "MID")], "HI", "m")
    got = dict((r.x, r.m) for r in big.collect())
    assert got[1200] == "LOW" and got[1600] == "MID" and got[1900] == "HI" and got[None] == "HI"


def test_tiered_lookup_existing_null_wins(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    t1 = spark.createDataFrame([(1, None), (2, "t1")], "k int, v string")
    t2 = spark.createDataFrame([(1, "t2"), (3, "t2")], "k int, v string")
    t3 = spark.createDataFrame([(1, "t3"), (2, "t3"), (3, "t3")], "k int, v string")
    out = cond.tiered_lookup(t, "k", [(t1, "v"), (t2, "v"), (t3, "v")], "v")
    assert dict((r.k, r.v) for r in out.collect()) == {1: None, 2: "t1", 3: "t2", 4: None}


def test_fill_null_and_decode(spark):
    t = spark.createDataFrame([(1, None), (2, "keep"), (3, None)], "k int, v string")
    other = spark.createDataFrame([(1, "from_other")], "k int, v string")
    out = cond.fill_null(t, "k", "v", other, default="dflt")
    assert dict((r.k, r.v) for r in out.collect()) == {1: "from_other", 2: "keep", 3: "dflt"}
    d = cond.decode(t, "k", {1: "one", 2: None}, "txt", default="?")
    assert dict((r.k, r.txt) for r in d.collect()) == {1: "one", 2: None, 3: "?"}


def test_region_map_null_is_other(spark):
    df = spark.createDataFrame([("DE",), ("JP",), ("US",), (None,)], "c string")
    out = cond.region_map(df, "c", "EU", "AS", "OT", "r")
    assert [r.r for r in out.collect()] == ["EU", "AS", "OT", "OT"]


def test_join_star_fallback_key_and_cross_refused(spark):
    a = spark.createDataFrame([(1, "m")], "MATNR int, x string")
    b = spark.createDataFrame([(1, "n")], "MATNR int, y string")
    c = spark.createDataFrame([("q",)], "z string")
    j = joins.join_tables_spec({"a": a, "b": b}, [])
    assert j.count() == 1
    with pytest.raises(joins.CrossJoinRefused):
        joins.join_tables_spec({"a": a, "c": c}, [])
    assert joins.join_tables_spec({"a": a, "c": c}, [], allow_cross=True).count() == 1
    assert joins.common_key(["KUNNR", "MATNR"], ["MATNR", "KUNNR"]) == "MATNR"


def test_semi_anti_null_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(joins.semi_exists(a, b, "k"), "k") == [(1,)]
    assert sorted([r.k for r in joins.anti_exists(a, b, "k").collect()], key=lambda x: (x is not None, x)) == [None, 2]


def test_latest_per_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "c"), (2, 1, "d")], "g int, ver int, x string")
    assert rows(aggs.latest_per(df, ["g"], "ver"), "x") == [("a",), ("b",), ("d",)]


def test_aggregate_aliases_and_passthrough(spark, target):
    out = aggs.aggregate(target, [], [("SUM", "val"), ("COUNT", "*"), ("stddev_samp", "val", "sd")])
    assert out.columns == ["sum_val", "count_all", "sd"]
    with pytest.raises(ValueError):
        aggs.aggregate(target, [], [("drop_table", "val")])


def test_key_check_and_assert_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,), (3,), (3,)], "k int")
    r = quality.key_check(df, "k").first()
    assert (r.rows, r.null_count, r.duplicate_groups) == (8, 2, 2)
    with pytest.raises(quality.KeyRejected):
        quality.assert_key(df, "k")
    assert quality.assert_key(df, "k", distinct=True).count() == 3
    assert quality.choose_key(["PRODUCT", "MATNR"], ["MATNR"], [{"target_col": "PRODUCT", "source_col": "MATNR"}]) \
        == ("PRODUCT", "MATNR")
    assert quality.choose_key(["A", "X_ID"], ["X_ID", "A"]) == ("X_ID", "X_ID")


def test_validate_rules(spark):
    df = spark.createDataFrame([(1, 5, "ab"), (1, 50, None), (None, 10, "zz")], "k int, q int, s string")
    ref = spark.createDataFrame([(1,)], "r int")
    out = quality.validate(df, [{"field": "k", "rule_type": "not_null"}, {"field": "k", "rule_type": "unique"},
                                {"field": "q", "rule_type": "range", "parameters": {"min": 1, "max": 20}},
                                {"field": "s", "rule_type": "regex", "parameters": {"pattern": "^a"}},
                                {"field": "k", "rule_type": "exists_in",
                                 "parameters": {"reference_table": ref, "reference_field": "r"}},
                                {"field": "k", "rule_type": "weird"}])
    res = sorted([tuple(r) for r in out.collect()], key=str)
    assert ("Valid", "Invalid: Duplicate value", "Valid", "Valid", "Valid", "Unknown validation rule: weird", 1, 5,
            "ab") in res
    assert ("Invalid: Null value", "Invalid: Null value", "Valid", "Invalid: Pattern mismatch",
            "Invalid: Reference not found", "Unknown validation rule: weird", None, 10, "zz") in res
    assert any(r[2] == "Invalid: Out of range" and r[3] == "Invalid: Pattern mismatch" for r in res)


def test_missing_mandatory_and_profile(spark, target):
    meta = spark.createDataFrame([("k", "True"), ("absent", "True"), ("name", "False")], "fields string, isMandatory string")
    assert rows(quality.missing_mandatory(target, meta), "field") == [("absent",)]
    p = quality.profile(target)
    assert p.count() == 3
    assert p.where(F.col("column") == "k").first().nulls == 1


def test_s14_diff_null_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "w")], "k int, v string")
    keyed = dict((r.k, r.status) for r in diff.diff_keyed(a, b, ["k"]).collect())
    assert keyed == {2: "changed", 3: "removed", 4: "new"}
    strict = dict((r.k, r.status) for r in diff.diff_keyed(a, b, ["k"], null_equal=False).collect())
    assert strict[1] == "changed"
    new, removed = diff.diff_rows(a, b)
    assert rows(new, "k", "v") == [(2, "z"), (4, "w")]
    assert rows(removed, "k", "v") == [(2, "x"), (3, "y"), (3, "y")]   # repeats kept
    n2, r2 = diff.diff_rows(a, a)
    assert n2.count() == 0 and r2.count() == 0


def test_update_then_diff_is_touched_keys(spark, target, lookup):
    updated = mutate.update_from(target, lookup, ("k", "lk"), {"name": "v"})
    changed = {r.k for r in diff.diff_keyed(target, updated, ["k"]).collect()}
    assert changed == {1, 2}


def test_cross_segment_keeps_row_count(spark):
    main = spark.createDataFrame([(1, "a"), (2, "b")], "KUNNR int, n string")
    seg = spark.createDataFrame([(1, 5.0), (1, 6.0), (3, 7.0)], "KUNNR int, bal double")
    out = joins.cross_segment(main, {"s": seg})
    assert out.count() == 2 and dict((r.KUNNR, r.bal) for r in out.collect()) == {1: 5.0, 2: None}


def test_find_relationships(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "pk int")
    out = quality.find_relationships({"c": child, "p": parent}, 1.0)
    got = {(r.child_table, r.child_column, r.parent_table, r.parent_column) for r in out.collect()}
    assert ("c", "fk", "p", "pk") in got and ("p", "pk", "c", "fk") not in got


def test_check_result_and_summary(spark, target):
    result = target.select("k", "name", F.lit(None).cast("string").alias("empty"))
    r = quality.check_result(target, result, ["k", "name"]).first()
    assert (r.target_rows, r.result_rows, r.rows_ok, r.columns_ok) == (5, 5, True, True)
    assert list(r.populated_columns) == ["k", "name"]
    s = aggs.summary(result).first()
    assert (s.rows, s.populated) == (5, 2)


def test_sample_and_view(spark, target):
    from tablewright.sources import as_view, sample
    assert [r.k for r in sample(target, 2, ["k"]).collect()] == [None, 1]
    as_view(target, "tw_target_view")
    assert spark.sql("SELECT count(*) FROM tw_target_view").first()[0] == 5


def test_reference_helper_names():
    from tablewright import functions as fn
    assert filters.filter_dataframe is filters.filter_rows and aggs.aggregate_data is aggs.aggregate
    assert joins.join_tables is joins.add_fields and cond.conditional_mapping is cond.case_map
    assert fn.handle_sap_leading_zeros is fn.leading_zeros


def test_cross_segment_key_mapping(spark):
    main = spark.createDataFrame([("P1", "x"), ("P2", "y")], "PRODUCT string, n string")
    seg = spark.createDataFrame([("P1", "ROH"), ("P1", "FERT"), ("P3", "HALB")], "MATNR string, MTART string")
    out = joins.cross_segment(main, {"basic": seg}, key_mapping={"PRODUCT": "MATNR"})
    assert sorted((r.PRODUCT, r.MTART) for r in out.collect()) == [("P1", "FERT"), ("P2", None)]


def test_diff_dispatch(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert {(r.k, r.status) for r in diff.diff(a, b, ["k"]).collect()} == {(2, "changed")}
    assert {(r.k, r.v, r.status) for r in diff.diff(a, b).collect()} == {(2, "z", "new"), (2, "y", "removed")}


def test_assume_unique_skips_aggregate(spark, target):
    src = spark.createDataFrame([(1, "u1"), (2, "u2")], "lk int, v string")
    fast = mutate.lookup(target, src, ("k", "lk"), "v", "name", assume_unique=True)
    safe = mutate.lookup(target, src, ("k", "lk"), "v", "name")
    assert sorted(map(str, fast.collect())) == sorted(map(str, safe.collect()))
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_blank_and_null_string_keys(spark):
    t = spark.createDataFrame([("",), (None,), ("A",)], "k string")
    src = spark.createDataFrame([("", "blank"), (None, "null"), ("A", "a")], "k string, v string")
    got = {r.k: r.v for r in mutate.lookup(t, src, "k", "v", "v").collect()}
    assert got == {"": "blank", None: None, "A": "a"}
    upd = {r.k: r.v for r in mutate.update_from(t.withColumn("v", F.lit("old")), src, "k", {"v": "v"}).collect()}
    assert upd == {"": "blank", None: "old", "A": "a"}


def test_relationships_equal_joins(spark):
    """Inverted values against distinct lists and semi joins, with NULLs, a hot
    value, columns of other types, more columns than one set holds, and covers on
    both sides of the threshold."""
    many = spark.createDataFrame([tuple([i % 7] * 70)  for i in range(20)], ", ".join(f"x{i} int" for i in range(70)))
    a = spark.createDataFrame([(1, "1", 5), (2, "b", 5), (None, None, 5), (9, "c", None)] + [(1, "1", 6)] * 50, "k int, s string, v long")
    b = spark.createDataFrame([(1, "b"), (2, "c"), (3, "1"), (4, None)], "k int, s string")
    empty = spark.createDataFrame([], "k int")
    tables = {"a": a, "b": b, "many": many, "empty": empty}
    values = {(t, f.name): (f.dataType.simpleString(), {r[0] for r in d.select(f.name).collect()} - {None}) for t, d in tables.items() for f in d.schema.fields}
    for cover in (0.3, 0.66, 0.67, 1.0):
        got = {tuple(r)[:6] for r in quality.find_relationships(tables, cover).collect()}
        exp = {(*x, *y, len(vx), len(vx & vy)) for x, (tx, vx) in values.items() for y, (ty, vy) in values.items()
               if x[0] != y[0] and tx == ty and vx and len(vx & vy) / len(vx) >= cover}
        assert got == exp and exp
    pairs = [("a", "k", "b", "k"), ("a", "s", "b", "k"), ("empty", "k", "a", "k")]
    got = {tuple(r)[:6] for r in quality.find_relationships(tables, 0.1, pairs).collect()}
    assert got == {("a", "k", "b", "k", 3, 2), ("a", "s", "b", "k", 3, 1)}
    plan = quality.find_relationships(tables, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(kind") == 1


def test_profile_plans_and_errors(spark):
    rows = spark.range(0, 20000).select((F.col("id") % 5000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"),
                                        F.lit(None).cast("string").alias("none"), F.array(F.col("id") % 3).alias("list"))
    exact = {r.column: r for r in quality.profile(rows, quantiles=(0.0, 0.5, 1.0)).collect()}
    assert [exact[c].distinct for c in ("a", "b", "none", "list")] == [5000, 10000, 0, 3]
    assert exact["a"].quantiles == [0.0, 2499.0, 4999.0] and exact["b"].quantiles is None
    about = quality.profile(rows, exact_distinct=False)
    for r in about.collect():
        assert abs(r.distinct - exact[r.column].distinct) <= 4 * quality.DISTINCT_ERROR * exact[r.column].distinct
        assert (r.rows, r.nulls, r.min, r.max) == (20000, exact[r.column].nulls, exact[r.column].min, exact[r.column].max)
    for df in (about, quality.profile(rows)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
