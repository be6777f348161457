"""Registered queries over sources and sinks, published tables, column metadata,
NULL handling and the run rules that the other modules leave out."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewright import sources
from tablewright.operators import conditional as cond, filters, joins, mutate, quality
from tablewright.plans import runs
from tablewright.plans.engine_queries import _folder, _steps
from tablewright.plans.lineage import sync_check
from tablewright.plans.registry import T, empty, register
from tablewright.plans.steps import Step

# ====================================================================== A7-A12: backups, publishing, views, files

#: A text for each order: NULL, empty, quotes and commas, a line break, outer blanks, backslashes.
_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(34) || 'a' || chr(34) || ', ' || o_orderstatus
WHEN 3 THEN 'two' || chr(10) || o_orderpriority WHEN 4 THEN '  blanks ' WHEN 5 THEN 'c:' || chr(92) || o_orderstatus || chr(92) ELSE o_orderpriority END"""
_TEXT_ROWS = f"SELECT o_orderkey, {_TEXT} AS txt, o_totalprice FROM orders"
_TEXT_SCHEMA = "o_orderkey long, txt string, o_totalprice double"


def _texts(spark, d):
    return T(spark, d, "orders").select("o_orderkey", F.expr(_TEXT).alias("txt"), F.col("o_totalprice").cast("double").alias("o_totalprice"))


@register("csv_round_trip", _TEXT_ROWS)
def q_csv(spark, d):
    # A10, A12.
    return sources.read_csv(spark, sources.write_csv(_texts(spark, d), _folder(spark, "csv")), _TEXT_SCHEMA)


@register("json_round_trip", _TEXT_ROWS)
def q_json_round_trip(spark, d):
    # A11.
    return sources.read_json(spark, sources.write_json(_texts(spark, d), _folder(spark, "json")), _TEXT_SCHEMA)


_LINE = "CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || ',none' WHEN 1 THEN o_orderkey || ',1.5,more' ELSE o_orderkey || ',2.5' END"


@register("csv_rescued", f"""
SELECT CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE 2.5 END AS v,
       CASE WHEN o_orderkey % 5 < 2 THEN {_LINE} END AS malformed
FROM orders
""")
def q_csv_rescued(spark, d):
    # Lines with text for a number or a field too many are kept apart, whole.
    path = _folder(spark, "lines")
    T(spark, d, "orders").select(F.expr(_LINE).alias("value")).write.text(path)
    rows = sources.read_csv(spark, path, "k long, v double", header=False, rescued="malformed", multiline=False)
    good, bad = sources.split_rescued(rows, "malformed")
    none = F.lit(None)
    return good.withColumn("malformed", none.cast("string")).unionByName(
        bad.select(none.cast("long").alias("k"), none.cast("double").alias("v"), "malformed"))


@register("backup_and_overwrite", """
SELECT 'backup' AS copy, c_custkey, c_name FROM customer UNION ALL SELECT 'table', c_custkey, c_name FROM customer WHERE c_nationkey < 5
""")
def q_backup(spark, d):
    # The table is replaced, its backup keeps what it held.
    path = _folder(spark, "table")
    table = sources.publish(T(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    kept = sources.backup(table, f"{path}_backup")
    table = sources.overwrite(kept.where("c_nationkey < 5"), path)
    cols = ["c_custkey", "c_name"]
    return kept.select(F.lit("backup").alias("copy"), *cols).unionByName(table.select(F.lit("table").alias("copy"), *cols))


@register("lost_write_keeps_table", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def q_lost_write(spark, d):
    # A replacement that fails in its tasks leaves the table as it was.
    path = _folder(spark, "table")
    rows = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sources.publish(rows.where("o_orderkey % 2 = 0"), path)
    lost = F.when(F.col("o_orderkey") % 97 == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("o_orderstatus"))
    try:
        sources.publish(rows.withColumn("o_orderstatus", lost), path)
    except (PySparkException, Py4JJavaError):
        return runs.ensure_snapshot(rows, path)
    raise AssertionError("the write did not fail")


@register("view_statement", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def q_view(spark, d):
    # A9.
    sources.as_view(T(spark, d, "customer").where("c_acctbal > 0"), "tw_positive")
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM tw_positive GROUP BY c_nationkey")


# ====================================================================== B4, B6, J1: filters, outer joins

_SPARSE = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"
_CHECKS = (("equals", "p", "1-URGENT", "p = '1-URGENT'"), ("not_equals", "p", "1-URGENT", "p <> '1-URGENT'"), ("contains", "p", "IGH", "contains(p, 'IGH')"),
           ("ends_with", "p", "LOW", "p LIKE '%LOW'"), ("in", "p", ["2-HIGH", "5-LOW"], "p IN ('2-HIGH', '5-LOW')"),
           ("not_in", "p", ["2-HIGH", "5-LOW"], "p NOT IN ('2-HIGH', '5-LOW')"), ("is_null", "p", None, "p IS NULL"), ("not_null", "p", None, "p IS NOT NULL"),
           ("gt", "k", 500, "k > 500"), ("ge", "k", 500, "k >= 500"), ("lt", "k", 500, "k < 500"), ("le", "k", 500, "k <= 500"))


@register("filter_row_operators", " UNION ALL ".join(
    f"SELECT '{op}' AS op, count(*) AS n FROM (SELECT o_orderkey AS k, {_SPARSE} AS p FROM orders) WHERE {sql}" for op, _, _, sql in _CHECKS))
def q_filter_operators(spark, d):
    # B4.
    rows = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_SPARSE).alias("p"))
    out = None
    for op, field, value, _ in _CHECKS:
        n = filters.filter_rows(rows, field, op, value).agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@register("null_rows", f"SELECT o_orderkey FROM orders WHERE {_SPARSE} IS NULL")
def q_null_rows(spark, d):
    # B6.
    return T(spark, d, "orders").withColumn("p", F.expr(_SPARSE)).where(filters.is_null("p")).select("o_orderkey")


@register("join_outer_types", " UNION ALL ".join(f"""
SELECT '{how}' AS how, c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 12) c
{how} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey""" for how in ("LEFT", "RIGHT", "FULL")))
def q_join_outer(spark, d):
    # J1.
    c, o = T(spark, d, "customer").where("c_nationkey < 12"), T(spark, d, "orders").where("o_orderstatus = 'F'")
    out = None
    for how in ("LEFT", "RIGHT", "FULL"):
        found = joins.join_tables_spec({"c": c, "o": o}, [joins.JoinCondition("c", "o", "c_custkey", "o_custkey", how)])
        found = joins.select_qualified(found, ["c.c_custkey", "o.o_orderkey"]).withColumn("how", F.lit(how))
        out = found if out is None else out.unionByName(found)
    return out


# ====================================================================== C12, D7-D9: metadata, mapped values

@register("column_registry", """
SELECT n_nationkey AS field_id, n_name AS fields, n_regionkey AS segement_id_id, 'False' AS "isKey" FROM nation WHERE n_name <> 'NATION_3'
UNION ALL SELECT max(n_nationkey) + 1, 'NEW_FIELD', 1, 'True' FROM nation
""")
def q_column_registry(spark, d):
    # A column is registered with the next number; another is removed.
    nation = T(spark, d, "nation")
    meta = nation.select(F.col("n_nationkey").cast("long").alias("field_id"), F.col("n_name").alias("fields"), F.lit("").alias("description"),
                         F.lit("False").alias("isMandatory"), F.lit("False").alias("isKey"), F.lit(None).cast("string").alias("source_table"),
                         F.lit(None).cast("string").alias("sap_structure"), F.lit(1).cast("long").alias("obj_id_id"),
                         F.col("n_regionkey").cast("long").alias("segement_id_id"), F.lit(1).cast("long").alias("project_id_id"))
    meta = mutate.meta_add(meta, "NEW_FIELD", "new", obj_id=1, segment_id=1, project_id=1, is_key=True)
    for segment in range(5):
        meta = mutate.meta_remove(meta, "NATION_3", obj_id=1, segment_id=segment, project_id=1)
    return meta.select("field_id", "fields", "segement_id_id", "isKey")


@register("map_fields_keyed", """
SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 2
""")
def q_map_fields(spark, d):
    # D7.
    target = T(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return cond.map_fields(target, T(spark, d, "nation"), {"c_name": "n_name"}, ("c_nationkey", "n_nationkey"),
                           conds={"n_regionkey": 2}).select("c_custkey", "c_name", "c_mktsegment")


@register("decode_table", """
SELECT o_orderkey, coalesce(t.name, 'unknown') AS customer FROM orders
LEFT JOIN (SELECT c_custkey AS code, min(c_name) AS name FROM customer WHERE c_nationkey < 20 GROUP BY 1) t ON t.code = o_custkey
""")
def q_decode_table(spark, d):
    # The codes are a table that grows with the data.
    codes = T(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("text"))
    return cond.decode(T(spark, d, "orders"), "o_custkey", codes, "customer", "unknown").select("o_orderkey", "customer")


@register("null_helpers", f"""
SELECT o_orderkey, coalesce({_SPARSE}, o_orderstatus, 'none') AS first_value, ifnull({_SPARSE}, 'missing') AS filled,
       CASE WHEN {_SPARSE} = '1-URGENT' THEN 'rush' ELSE 'wait' END AS speed FROM orders
""")
def q_null_helpers(spark, d):
    # D9.
    rows = T(spark, d, "orders").withColumn("p", F.expr(_SPARSE))
    return rows.select("o_orderkey", cond.coalesce("p", "o_orderstatus", F.lit("none")).alias("first_value"), cond.ifnull("p", "missing").alias("filled"),
                       cond.iif(F.col("p") == "1-URGENT", "rush", "wait").alias("speed"))


# ====================================================================== V1, R8, R10, R12

@register("validate_null_values", f"""
SELECT CASE WHEN p IS NULL THEN 'Invalid: Null value' ELSE 'Valid' END AS validation_result_1,
       CASE WHEN d IS NULL THEN 'Invalid: Null value' WHEN count(*) OVER (PARTITION BY d) > 1 THEN 'Invalid: Duplicate value' ELSE 'Valid' END AS validation_result_2,
       o_orderkey
FROM (SELECT o_orderkey, {_SPARSE} AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -1 ELSE o_orderkey END AS d FROM orders)
""")
def q_validate_nulls(spark, d):
    # V1 and V2 with NULLs.
    key = F.col("o_orderkey")
    rows = T(spark, d, "orders").select("o_orderkey", F.expr(_SPARSE).alias("p"), F.when(key % 4 == 1, F.lit(-1)).when(key % 4 != 0, key).alias("d"))
    return quality.validate(rows, [quality.Rule("p", "not_null"), quality.Rule("d", "unique")], ["o_orderkey"]).select(
        "validation_result_1", "validation_result_2", "o_orderkey")


@register("sync_check_equal", """
SELECT count(*) AS target_row_count, count(*) AS source_row_count, true AS row_counts_match, true AS schemas_match, true AS in_sync FROM orders
""")
def q_sync_equal(spark, d):
    # R8.
    orders = T(spark, d, "orders")
    return sync_check(orders, runs.ensure_snapshot(orders, _folder(spark, "src")))


_REFERENCES = ("the previous one", "transformation 1", "query 2", "what came from customer", "BRING")


@register("find_logged_steps", """
WITH n AS (SELECT count(*) AS n FROM customer WHERE c_acctbal > 0)
SELECT reference, transformation_id, n * seq AS "rows" FROM n, (VALUES ('the previous one', 't_3', 3), ('transformation 1', 't_1', 1), ('query 2', 't_2', 2),
  ('what came from customer', 't_1', 1), ('BRING', 't_1', 1)) AS r(reference, transformation_id, seq)
""")
def q_find_steps(spark, d):
    # Numbered, relative and named references.
    path, n = _folder(spark, "log"), T(spark, d, "customer").where("c_acctbal > 0").count()
    for i, step in enumerate(_steps()):
        log = runs.log_step(spark, path, "s", step, "tgt", n * (i + 1))
    out = None
    for reference in _REFERENCES:
        found = runs.find_step(log, "s", reference).select(F.lit(reference).alias("reference"), "transformation_id", "rows")
        out = found if out is None else out.unionByName(found)
    return out


@register("retry_rules", """
SELECT c_custkey AS cust, c_nationkey AS nation, 2 AS tries_of_lost, 1 AS tries_of_duplicate FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_retry(spark, d):
    # A lost step is tried again, a column that exists is not.
    tries = {"lost": 0, "duplicate": 0}

    def lost(t, s):
        tries["lost"] += 1
        if tries["lost"] == 1:
            raise RuntimeError("executor lost")
        return mutate.insert_select(t, s["customer"], {"cust": "c_custkey", "nation": "c_nationkey"}, {"c_mktsegment": "BUILDING"})

    def duplicate(t, s):
        tries["duplicate"] += 1
        return mutate.add_column(t, "nation")

    customer = {"customer": T(spark, d, "customer")}
    target = empty(spark, "cust long, nation long")
    done = runs.run_steps(spark, "lost", [Step("bring", lost)], target, customer, run_dir=_folder(spark, "run"), retries=1)
    try:
        runs.run_steps(spark, "duplicate", [Step("add", duplicate)], done.target, customer, run_dir=_folder(spark, "run"), retries=3)
    except runs.StepFailed:
        return done.target.select("*", F.lit(tries["lost"]).alias("tries_of_lost"), F.lit(tries["duplicate"]).alias("tries_of_duplicate"))
    raise AssertionError("a column that exists was added")


