"""Registered queries over statements, requests and runs that Spark builds from
the given tables.

``orders`` carries no SQL, so each order row becomes a statement and a request:
the key modulo picks a template, the key names the table.  The same SQL
expression builds them in Spark and in DuckDB; what each template must come out
as is stated by hand in the oracle."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tablewright.operators import joins, metadata, mutate, quality
from tablewright.plans import requests as rq, runs
from tablewright.plans.lineage import lineage, lineage_counts
from tablewright.plans.registry import ORACLE, QUERIES, T, empty, register
from tablewright.plans.steps import ColumnLineage, Step
from tablewright.session import checkpoint_root

_K = "CAST(o_orderkey AS STRING)"
_KEEP = "Data preservation operation - "
_ALTERS = "Data transformation detected - preserving original data"
#: statement (# is the order's key, ~ a quote), kind, target, transformation type, sync reason.
STATEMENTS = (
    ("INSERT INTO [T_#] (A) SELECT a FROM src", "INSERT-SELECT", "T_#", "none", _KEEP + "INSERT-SELECT"),
    ("INSERT INTO T_# VALUES (1)", "INSERT", "T_#", "none", _KEEP + "INSERT"),
    ("UPDATE T_# SET A = b FROM src WHERE src.k = k", "UPDATE-FROM", "T_#", "none", _KEEP + "UPDATE-FROM"),
    ("UPDATE T_# SET A = UPPER(b)", "UPDATE", "T_#", "string_manipulation", _ALTERS),
    ("UPDATE T_# SET A = b", "UPDATE", "T_#", "none", _KEEP + "UPDATE"),
    ("ALTER TABLE T_# ADD COLUMN C TEXT", "ALTER-ADD", "T_#", "none", _KEEP + "ALTER-ADD"),
    ("ALTER TABLE T_# DROP COLUMN C", "ALTER-DROP", "T_#", "none", _KEEP + "ALTER-DROP"),
    ("DELETE FROM T_# WHERE A IS NULL", "DELETE", None, "none", _KEEP + "DELETE"),
    ("SELECT SUM(a) FROM T_#", "OTHER", None, "aggregation", "Not a target table operation"),
    ("UPDATE T_# SET A = price * 2", "UPDATE", "T_#", "mathematical", _ALTERS),
    ("UPDATE T_# SET A = CASE WHEN b = 1 THEN ~X~ END", "UPDATE", "T_#", "constant_assignment", _ALTERS),
    ("UPDATE T_# SET A = DATE(b)", "UPDATE", "T_#", "date_transformation", "Complex transformation detected"),
    ("CREATE TEMP TABLE x AS SELECT 1; UPDATE T_# SET A = b FROM s", "UPDATE-FROM", "T_#", "none", "Operation type not suitable for sync"),
    ("", "OTHER", None, "none", "Missing query or target table"),
    ("UPDATE OTHER_# SET A = b FROM s", "UPDATE-FROM", "OTHER_#", "none", "Not a target table operation"),
)
#: request, class.
REQUESTS = (
    ("Join MARA with MARC for order #", "JOIN_OPERATION"), ("Copy MAKT texts onto MARA for order #", "JOIN_OPERATION"),
    ("Take the plant of order # from segment two", "CROSS_SEGMENT"), ("Validate the plant of order #", "VALIDATION_OPERATION"),
    ("Average the price of order #", "AGGREGATION_OPERATION"), ("Bring the material of order # from MARA", "SIMPLE_TRANSFORMATION"),
)


def _template(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    parts = [f"'{p}'" for p in text.replace("#", "\0#\0").replace("~", "\0~\0").split("\0") if p]
    return " || ".join(_K if p == "'#'" else "chr(39)" if p == "'~'" else p for p in parts) or "''"


def _pick(rows, column: int) -> str:
    """SQL for the given column of the row that the order's key picks."""
    whens = " ".join(f"WHEN {i} THEN {_template(r[column])}" for i, r in enumerate(rows))
    return f"CASE o_orderkey % {len(rows)} {whens} END"


def _orders(spark, d):
    return T(spark, d, "orders").select("o_orderkey", F.expr(_pick(STATEMENTS, 0)).alias("sql"), F.expr(f"'T_' || {_K}").alias("t"),
                                        F.expr(_pick(REQUESTS, 0)).alias("request"))


@register("classify_requests", f"SELECT o_orderkey, {_pick(REQUESTS, 1)} AS query_type FROM orders")
def q_classify(spark, d):
    return rq.classify_requests(_orders(spark, d), "request").select("o_orderkey", "query_type")


@register("sql_transform_type", f"SELECT o_orderkey, {_pick(STATEMENTS, 3)} AS transformation_type FROM orders")
def q_transform_type(spark, d):
    return rq.sql_transform_type(_orders(spark, d), "sql").select("o_orderkey", "transformation_type")


@register("sql_kind_target", f"SELECT o_orderkey, {_pick(STATEMENTS, 1)} AS statement_kind, {_pick(STATEMENTS, 2)} AS target_table FROM orders")
def q_kind(spark, d):
    return rq.sql_target(rq.sql_kind(_orders(spark, d), "sql"), "sql").select("o_orderkey", "statement_kind", "target_table")


@register("sql_sync_decision", f"""
SELECT o_orderkey, {_pick(STATEMENTS, 4)} AS sync_reason, starts_with({_pick(STATEMENTS, 4)}, 'Data preservation') AS sync FROM orders
""")
def q_sync_decision(spark, d):
    return rq.sql_sync_decision(_orders(spark, d), "sql", "t").select("o_orderkey", "sync", "sync_reason")


# ====================================================================== runs

def _steps(fail: bool = False):
    def text(t, s):
        if fail:
            raise RuntimeError("source is locked")
        return mutate.lookup(t, s["nation"], ("nation", "n_nationkey"), "n_name", "nation_name")

    return [
        Step("bring", lambda t, s: mutate.insert_select(t, s["customer"], {"cust": "c_custkey", "nation": "c_nationkey"}, {"c_mktsegment": "BUILDING"}),
             kind="data_movement", statement="INSERT-SELECT", source_tables=("customer",), fields=("cust", "nation"),
             lineage=(ColumnLineage("cust", "customer", "c_custkey"), ColumnLineage("nation", "customer", "c_nationkey"))),
        Step("name", text, statement="UPDATE", source_tables=("nation",), fields=("nation_name",),
             lineage=(ColumnLineage("nation_name", "nation", "n_name"),)),
        Step("flag", lambda t, s: mutate.set_if(t, "nation", 3, "flag", "home", "abroad"), statement="UPDATE", fields=("flag",),
             lineage=(ColumnLineage("flag", None, None, "constant_assignment"),)),
    ]


def _target(spark):
    return empty(spark, "cust long, nation long, nation_name string, flag string")


def _sources(spark, d):
    return {n: T(spark, d, n) for n in ("customer", "nation")}


def _folder(spark, name):
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


_RUN_SQL = """
SELECT c_custkey AS cust, c_nationkey AS nation, n_name AS nation_name, CASE WHEN c_nationkey = 3 THEN 'home' ELSE 'abroad' END AS flag
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'"""


@register("run_resumes", _RUN_SQL)
def q_run_resumes(spark, d):
    # The second step fails, the next call goes on after the first.
    folder = _folder(spark, "run")
    try:
        runs.run_steps(spark, "demo", _steps(fail=True), _target(spark), _sources(spark, d), run_dir=folder, retries=0)
    except runs.StepFailed as exc:
        if exc.index != 2:
            raise
    out = runs.run_steps(spark, "demo", _steps(), _target(spark), _sources(spark, d), run_dir=folder)
    if out.resumed_from != 1:
        raise AssertionError("the run did not go on after its first step")
    return out.target


@register("run_summary", f"""
SELECT count(*) AS "rows", count(cust) AS cust, count(nation_name) AS nation_name, count(flag) AS flag FROM ({_RUN_SQL})
""")
def q_run_summary(spark, d):
    out = runs.run_steps(spark, "sum", _steps(), _target(spark), _sources(spark, d), run_dir=_folder(spark, "run"))
    s = out.summary
    return s.select("rows", *[F.col("non_null")[c].cast("long").alias(c) for c in ("cust", "nation_name", "flag")])


@register("apply_steps_with_src", f"""
SELECT 'target' AS side, cust, nation, nation_name FROM ({_RUN_SQL})
UNION ALL SELECT 'src', c_custkey, c_nationkey, NULL FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_apply_step(spark, d):
    # R2: only data movement reaches the _src copy.
    target, src = _target(spark), _target(spark)
    for step in _steps():
        target, src = runs.apply_step(step, target, src, _sources(spark, d))
    cols = ["cust", "nation", "nation_name"]
    return target.select(F.lit("target").alias("side"), *cols).unionByName(src.select(F.lit("src").alias("side"), *cols))


@register("snapshot_kept", "SELECT n_nationkey, n_name FROM nation")
def q_snapshot(spark, d):
    # The second call keeps the first snapshot, whatever it is given.
    path = _folder(spark, "snapshot")
    nation = T(spark, d, "nation").select("n_nationkey", "n_name")
    runs.ensure_snapshot(nation, path)
    return runs.ensure_snapshot(nation.where("false"), path)


@register("step_log", """
SELECT 't_2' AS transformation_id, 2 AS seq, 'UPDATE' AS query_type, count(*) AS "rows" FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_step_log(spark, d):
    # R9, R10.
    path = _folder(spark, "log")
    rows = T(spark, d, "customer").where("c_mktsegment = 'BUILDING'").count()
    for step in _steps():
        log = runs.log_step(spark, path, "s1", step, "target", rows)
    return runs.find_step(log, "s1", "step 2").select("transformation_id", "seq", "query_type", "rows")


@register("step_lineage", f"""
WITH t AS ({_RUN_SQL}), l AS (SELECT * FROM (VALUES ('bring', 1, 'cust', 'customer', 'c_custkey', false), ('bring', 1, 'nation', 'customer', 'c_nationkey', false),
  ('name', 2, 'nation_name', 'nation', 'n_name', false), ('flag', 3, 'flag', NULL, NULL, true))
  AS l(step_name, step_index, target_column, source_table, source_column, transformation_applied))
SELECT l.*, CASE target_column WHEN 'cust' THEN (SELECT count(cust) FROM t) WHEN 'nation' THEN (SELECT count(nation) FROM t)
              WHEN 'nation_name' THEN (SELECT count(nation_name) FROM t) ELSE (SELECT count(flag) FROM t) END AS filled,
       CASE source_column WHEN 'c_custkey' THEN (SELECT count(c_custkey) FROM customer) WHEN 'c_nationkey' THEN (SELECT count(c_nationkey) FROM customer)
              WHEN 'n_name' THEN (SELECT count(n_name) FROM nation) END AS source_filled
FROM l
""")
def q_lineage(spark, d):
    # The declared lineage, with what the run filled of what its sources hold.
    target, sources = _target(spark), _sources(spark, d)
    for step in _steps():
        target = step.apply(target, sources)
    out = lineage_counts(lineage(spark, _steps(), "target"), target, sources)
    return out.select(F.col("step").alias("step_name"), "step_index", "target_column", "source_table", "source_column", "transformation_applied",
                      "filled", "source_filled")


# ====================================================================== mappings, keys, updates

@register("mapping_update", """
SELECT c_custkey, n.n_name AS c_name FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION ALL SELECT c_custkey, c_name FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 OR n_regionkey IS NULL
""")
def q_mapping_update(spark, d):
    # A target with rows takes the update branch.
    target = T(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return mutate.apply_mapping(target, T(spark, d, "nation"), {"c_name": "n_name"}, key=("c_nationkey", "n_nationkey"),
                                conds={"n_regionkey": 1}).select("c_custkey", "c_name")


@register("update_with_nulls", """
WITH s AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS a,
                  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS ord, o_orderstatus AS b FROM orders),
     r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord NULLS LAST, a NULLS LAST, b NULLS LAST) AS i FROM s)
SELECT c_custkey, CASE WHEN r.k IS NULL THEN c_name ELSE r.a END AS c_name, CASE WHEN r.k IS NULL THEN c_mktsegment ELSE r.b END AS c_mktsegment
FROM customer LEFT JOIN r ON r.k = c_custkey AND i = 1
""")
def q_update_with_nulls(spark, d):
    src = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("a"),
                                       F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("ord"), F.col("o_orderstatus").alias("b"))
    target = T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return mutate.update_from(target, src, ("c_custkey", "k"), {"c_name": "a", "c_mktsegment": "b"}, order="ord")


@register("keyed_diff_nulls", """
WITH a AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0),
     b AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0),
     c AS (SELECT k, v, sum(na) AS na, sum(nb) AS nb FROM (SELECT k, v, 1 AS na, 0 AS nb FROM a UNION ALL SELECT k, v, 0, 1 FROM b) GROUP BY k, v),
     p AS (SELECT k, sum(na) AS na, sum(nb) AS nb, max(na <> nb) AS differs FROM c GROUP BY k)
SELECT k, CASE WHEN na = 0 THEN 'new' WHEN nb = 0 THEN 'removed' ELSE 'changed' END AS status FROM p WHERE na = 0 OR nb = 0 OR differs
""")
def q_keyed_diff_nulls(spark, d):
    from tablewright.operators import diff
    rows = T(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderstatus").alias("v"), "o_orderkey")
    return diff.diff_keyed(rows.where("o_orderkey % 5 <> 0").drop("o_orderkey"), rows.where("o_orderkey % 3 <> 0").drop("o_orderkey"), ["k"])


@register("composite_join", """
SELECT l.l_orderkey, l.l_linenumber, m.l_quantity FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber
""")
def q_composite_join(spark, d):
    lines = T(spark, d, "lineitem")
    on = [joins.JoinCondition("l", "m", c, c) for c in ("l_orderkey", "l_linenumber")]
    return joins.select_qualified(joins.join_tables_spec({"l": lines, "m": lines}, on), ["l.l_orderkey", "l.l_linenumber", "m.l_quantity"])


@register("map_long_lists", """
SELECT o_orderkey, CASE WHEN o_orderkey <= 1500 THEN 1 WHEN o_orderkey <= 3000 THEN NULL ELSE 7 END::INT AS grp FROM orders
""")
def q_map_long_lists(spark, d):
    from tablewright.operators import conditional as cond
    out = cond.map_in_lists(T(spark, d, "orders"), "o_orderkey", [(range(0, 1501), 1), (range(1501, 3001), None)], 7, "grp")
    return out.select("o_orderkey", "grp")


@register("dirty_text_insert", """
SELECT o_orderkey AS id, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS n FROM orders
WHERE CAST(o_custkey AS VARCHAR) <> '7'
""")
def q_dirty_text(spark, d):
    # Text without a number becomes NULL, literals take the column's type; nothing raises.
    dirty = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    src = mutate.delete_where(T(spark, d, "orders").withColumn("txt", F.col("o_custkey").cast("string")), {"txt": 7})
    return mutate.insert_select(empty(spark, "id long, n long"), src, {"id": "o_orderkey", "n": dirty})


@register("key_choice", "SELECT count(*) AS n, 'o_orderkey' AS key FROM orders")
def q_key_choice(spark, d):
    # K3, K4.
    orders = T(spark, d, "orders")
    _, key = quality.choose_key(["x", "o_orderkey"], orders.columns)
    try:
        quality.assert_key(orders, "o_orderstatus")
    except quality.KeyRejected:
        return quality.assert_key(orders, key).agg(F.count(F.lit(1)).alias("n"), F.lit(key).alias("key"))
    raise AssertionError("a column with duplicates was taken as key")


def _metadata(spark, d):
    fields = T(spark, d, "nation").select(
        F.col("n_nationkey").alias("field_id"), F.col("n_name").alias("fields"), F.lit("").alias("description"),
        F.when(F.col("n_nationkey") % 2 == 0, "True").otherwise("False").alias("isMandatory"), F.lit("False").alias("isKey"),
        F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit("S"), F.col("n_regionkey"))).alias("source_table"),
        F.lit(1).alias("obj_id_id"), (F.col("n_regionkey") % 2).alias("segement_id_id"), F.lit(1).alias("project_id_id"))
    rules = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("field_id"), (F.col("c_custkey") % 3).alias("version_id")).agg(
        F.min("c_name").alias("target_sap_field"))
    rules = rules.select("field_id", "version_id", F.when(F.col("field_id") % 2 == 0, F.col("target_sap_field")).otherwise("").alias("source_field_name"),
                         "target_sap_field", F.lit(1).alias("object_id_id"), (F.col("field_id") % 2).alias("__x"), F.lit(1).alias("project_id_id"))
    rules = rules.join(T(spark, d, "nation").select(F.col("n_nationkey").alias("field_id"), (F.col("n_regionkey") % 2).alias("segment_id_id")), "field_id").drop("__x")
    segments = T(spark, d, "region").select((F.col("r_regionkey") % 2).alias("segment_id")).distinct().select(
        "segment_id", F.lit(1).alias("obj_id_id"), F.lit(1).alias("project_id_id"), F.concat(F.lit("T"), F.col("segment_id")).alias("table_name"))
    return fields, rules, segments


@register("resolve_mapping", """
WITH v AS (SELECT c_nationkey AS field_id, c_custkey % 3 AS version_id, min(c_name) AS tgt FROM customer GROUP BY ALL),
     n AS (SELECT * FROM v QUALIFY version_id = max(version_id) OVER (PARTITION BY field_id)),
     f AS (SELECT n_nationkey AS field_id, n_name AS fields, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'S' || n_regionkey END AS st
           FROM nation WHERE n_regionkey % 2 = 1)
SELECT f.field_id, f.fields, coalesce(st, (SELECT min_by(st, field_id) FROM f WHERE st IS NOT NULL)) AS source_table, n.tgt AS source_field_name, 'T1' AS table_name
FROM f LEFT JOIN n USING (field_id)
""")
def q_resolve_mapping(spark, d):
    # M1, M2.
    found = metadata.resolve_mapping(*_metadata(spark, d), 1, 1, 1)
    return metadata.clean_mapping(found).select("field_id", "fields", "source_table", "source_field_name", "table_name")


@register("missing_mandatory", """
SELECT n_name AS field FROM nation WHERE n_nationkey % 2 = 0 AND n_name <> 'NATION_2'
""")
def q_missing_mandatory(spark, d):
    # V9: of the mandatory fields one is filled in the target.
    fields, _, _ = _metadata(spark, d)
    target = T(spark, d, "customer").select(F.col("c_name").alias("NATION_2"), F.lit(None).cast("string").alias("NATION_4"))
    return quality.missing_mandatory(target, fields)


# Queries that use the helpers above.
from tablewright.plans import table_queries  # noqa: E402,F401

__all__ = ["ORACLE", "QUERIES"]
