"""Registered queries: one per operator of SURVEY section 2, each over the
given tables (whole tables, whole texts), with the equivalent DuckDB SQL where
SQL can state it.  ``__spark_entry__`` exposes these to the driver."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.operators import aggs, conditional as cond, diff, filters, joins, mutate, quality
from tablewright.sources import scan, sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f
    return deco


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scan(spark, d, name)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# ====================================================================== sources, filters

@register("scan_count", "SELECT count(*) AS n FROM orders")
def q_scan_count(spark, d):
    return T(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))


@register("sample_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_sample_orders(spark, d):
    return sample(T(spark, d, "orders"), 5, ["o_orderkey"])


@register("truncate_orders", "SELECT * FROM orders WHERE false")
def q_truncate(spark, d):
    from tablewright.sources import truncate
    return truncate(T(spark, d, "orders"))


@register("simple_filter_insert", """
SELECT c_custkey AS cust_id, c_name AS cust_name FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_simple_filter_insert(spark, d):
    target = empty(spark, "cust_id long, cust_name string")
    return mutate.insert_select(target, T(spark, d, "customer"),
                                {"cust_id": "c_custkey", "cust_name": "c_name"},
                                {"c_mktsegment": "BUILDING"})


@register("where_map", """
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)
""")
def q_where_map(spark, d):
    return filters.select(T(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"],
                          {"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3], "c_name": None})


@register("filter_rows_prefix", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'
""")
def q_filter_rows(spark, d):
    return filters.filter_rows(T(spark, d, "orders"), "o_orderpriority", "starts_with", "1") \
        .select("o_orderkey", "o_orderpriority")


@register("distinct_nations", "SELECT DISTINCT c_nationkey FROM customer")
def q_distinct(spark, d):
    return filters.distinct(T(spark, d, "customer"), ["c_nationkey"])


@register("match_columns", """
SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal,
       CAST(NULL AS VARCHAR) AS region_code FROM customer
""")
def q_match_columns(spark, d):
    return filters.mapped_select(T(spark, d, "customer"), ["custkey", "name", "acctbal", "region_code"])


# ====================================================================== mutation

@register("lookup_overwrite", """
SELECT c_custkey, c_nationkey,
       (SELECT min(n_name) FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3) AS nation
FROM customer
""")
def q_lookup(spark, d):
    target = T(spark, d, "customer").select("c_custkey", "c_nationkey")
    return mutate.lookup(target, T(spark, d, "nation"), ("c_nationkey", "n_nationkey"), "n_name", "nation",
                         conds=F.col("n_regionkey") < 3)


@register("update_from_keep", """
SELECT c_custkey, CASE WHEN m.k IS NOT NULL THEN m.p ELSE c_acctbal END AS bal
FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders
                         WHERE o_orderstatus = 'F' GROUP BY 1) m ON m.k = c_custkey
""")
def q_update_from(spark, d):
    target = T(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    return mutate.update_from(target, T(spark, d, "orders"), ("c_custkey", "o_custkey"),
                              {"bal": "o_totalprice"}, {"o_orderstatus": "F"}, pick="max")


@register("apply_mapping_upsert", """
SELECT c_custkey AS cust_id, c_name AS cust_name FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
def q_apply_mapping(spark, d):
    # An empty target takes the INSERT branch.
    target = empty(spark, "cust_id long, cust_name string")
    return mutate.apply_mapping(target, T(spark, d, "customer"), {"cust_id": "c_custkey", "cust_name": "c_name"},
                                key=("cust_id", "c_custkey"), conds={"c_mktsegment": "MACHINERY"})


@register("set_if_flag", """
SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderpriority,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE 'NORMAL' END AS flag,
       'ERP' AS src
FROM orders
""")
def q_set_if(spark, d):
    df = T(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    df = mutate.set_if(df, "o_orderpriority", "1-URGENT", "flag", "URGENT", "NORMAL")
    df = mutate.set_default(df, "src", "ERP")
    return mutate.clear(df, "o_orderpriority")


@register("update_where_prefix", """
SELECT p_partkey, CASE WHEN lower(p_type) LIKE 'eco%' THEN 'ECO' ELSE p_type END AS p_type FROM part
""")
def q_update_prefix(spark, d):
    return mutate.update_where_prefix(T(spark, d, "part").select("p_partkey", "p_type"), "p_type", "eco", "ECO")


@register("add_drop_columns", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(NULL AS VARCHAR) AS note FROM customer
""")
def q_add_drop(spark, d):
    df = mutate.add_column(T(spark, d, "customer"), "note")
    return mutate.drop_column(df, "c_acctbal")


@register("delete_where", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)
""")
def q_delete_where(spark, d):
    return mutate.delete_where(T(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "F"})


@register("load_from_src", """
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
def q_load_from_src(spark, d):
    c = T(spark, d, "customer")
    target = c.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")
    src = c.where(F.col("c_mktsegment") == "MACHINERY").select("c_name", "c_custkey")
    return mutate.load_from_src(target, src)


# ====================================================================== conditional mapping

@register("map_in_lists", """
SELECT o_orderkey,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HI'
            WHEN o_orderpriority IN ('3-MEDIUM') THEN 'MID' ELSE 'LO' END AS band
FROM orders
""")
def q_map_in_lists(spark, d):
    df = T(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return cond.map_in_lists(df, "o_orderpriority", [(["1-URGENT", "2-HIGH"], "HI"), (["3-MEDIUM"], "MID")],
                             "LO", "band").drop("o_orderpriority")


@register("tiered_lookup", """
SELECT p0.p_partkey AS k,
       CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name
            WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE p.p_name END AS name
FROM part p0
LEFT JOIN supplier s ON s.s_suppkey = p0.p_partkey
LEFT JOIN customer c ON c.c_custkey = p0.p_partkey
LEFT JOIN part p ON p.p_partkey = p0.p_partkey
""")
def q_tiered(spark, d):
    target = T(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return cond.tiered_lookup(target, "k", [(T(spark, d, "supplier"), "s_suppkey", "s_name"),
                                            (T(spark, d, "customer"), "c_custkey", "c_name"),
                                            (T(spark, d, "part"), "p_partkey", "p_name")], "name")


@register("nested_map", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus,
       CASE WHEN o.o_orderstatus = 'F' THEN
            CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'B1'
                 WHEN c.c_nationkey IN (1, 2, 3, 4, 5) THEN 'R2' ELSE 'OTHER' END
       ELSE 'NA' END AS cls
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def q_nested(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = T(spark, d, "customer")
    return cond.nested_map(o, "o_custkey", F.col("o_orderstatus") == "F",
                           (c, "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "B1"),
                           (c, "c_custkey", "c_nationkey", [1, 2, 3, 4, 5], "R2"), "OTHER", "NA", "cls")


# Country codes for the region map, derived from the nation key by this fixed array
# (nation has no country code column); the oracle uses the same array.
NATION_CODES = ["DE", "FR", "IT", "CN", "JP", "US", "BR", "IN", "ES", "KR", "CA", "MX", "NL", "SG",
                "AU", "ZA", "SE", "TH", "PL", "VN", "EG", "AR", "MO", "CY", "XX"]
_codes_sql = "[" + ", ".join(f"'{c}'" for c in NATION_CODES) + "]"


@register("region_map", f"""
SELECT c_custkey,
       CASE WHEN list_element({_codes_sql}, c_nationkey + 1) IN
                 ('DE','FR','IT','ES','NL','BE','AT','CH','SE','NO','DK','FI','IE','PT','GR','PL',
                  'CZ','SK','HU','SI','HR','BG','RO','EE','LV','LT','LU','MT','CY') THEN 'EMEA'
            WHEN list_element({_codes_sql}, c_nationkey + 1) IN
                 ('CN','JP','KR','IN','TH','SG','MY','ID','PH','VN','TW','HK','MO') THEN 'APAC'
            ELSE 'OTHER' END AS region
FROM customer
""")
def q_region(spark, d):
    c = T(spark, d, "customer").select(
        "c_custkey", F.element_at(F.array(*[F.lit(x) for x in NATION_CODES]), F.col("c_nationkey") + 1).alias("code"))
    return cond.region_map(c, "code", "EMEA", "APAC", "OTHER", "region").drop("code")


@register("fill_null_fallback", """
SELECT c_custkey, c_nationkey,
       COALESCE(CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END,
                (SELECT min(n_name) FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 2),
                'NA') AS seg
FROM customer
""")
def q_fill_null(spark, d):
    c = T(spark, d, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("seg"))
    n = T(spark, d, "nation").where(F.col("n_regionkey") < 2)
    return cond.fill_null(c, ("c_nationkey", "n_nationkey"), "seg", n, "n_name", "NA")


@register("case_map", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity >= 40 THEN 'BULK' WHEN l_discount > 0.05 THEN 'PROMO' ELSE l_returnflag END AS kind
FROM lineitem
""")
def q_case_map(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    out = cond.case_map(li, [(F.col("l_quantity") >= 40, "BULK"), (F.col("l_discount") > 0.05, "PROMO")],
                        F.col("l_returnflag"), "kind")
    return out.select("l_orderkey", "l_linenumber", "kind")


# Brand code -> name map used by the decode query (caller-given dictionary).
BRAND_NAMES = {"Brand#1": "Acme", "Brand#2": "Globex", "Brand#3": "Initech", "Brand#4": "Umbrella",
               "Brand#5": "Hooli"}


@register("decode_brand", """
SELECT p_partkey,
       CASE p_brand WHEN 'Brand#1' THEN 'Acme' WHEN 'Brand#2' THEN 'Globex' WHEN 'Brand#3' THEN 'Initech'
                    WHEN 'Brand#4' THEN 'Umbrella' WHEN 'Brand#5' THEN 'Hooli' ELSE 'Other' END AS brand_name
FROM part
""")
def q_decode(spark, d):
    p = T(spark, d, "part").select("p_partkey", "p_brand")
    return cond.decode(p, "p_brand", BRAND_NAMES, "brand_name", default="Other").drop("p_brand")


# ====================================================================== joins

@register("join_star", """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate, p.p_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")
def q_join_star(spark, d):
    tables = {"lineitem": T(spark, d, "lineitem"), "orders": T(spark, d, "orders"), "part": T(spark, d, "part")}
    conds = [joins.JoinCondition("lineitem", "orders", "l_orderkey", "o_orderkey", "INNER"),
             joins.JoinCondition("part", "lineitem", "p_partkey", "l_partkey", "LEFT")]
    j = joins.join_tables_spec(tables, conds)
    return joins.select_qualified(j, ["lineitem.l_orderkey", "lineitem.l_linenumber", "orders.o_orderdate",
                                      "part.p_name"])


@register("join_three", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, m.nation, m.region
FROM lineitem l LEFT JOIN (
  SELECT s.s_suppkey AS k, min(n.n_name) AS nation, min(r.r_name) AS region
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1) m ON m.k = l.l_suppkey
""")
def q_join_three(spark, d):
    target = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.join_lookup(target, "l_suppkey", T(spark, d, "supplier"), T(spark, d, "nation"),
                             T(spark, d, "region"), ("s_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey"),
                             "s_suppkey", {"nation": "t2.n_name", "region": "t3.r_name"})


@register("semi_exists", """
SELECT c_custkey AS cust_id FROM customer
WHERE c_mktsegment = 'BUILDING'
  AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
""")
def q_semi(spark, d):
    target = empty(spark, "cust_id long")
    return joins.insert_where_exists(target, T(spark, d, "customer"), T(spark, d, "orders"),
                                     ("c_custkey", "o_custkey"), {"cust_id": "c_custkey"},
                                     conds={"c_mktsegment": "BUILDING"}, other_conds={"o_orderstatus": "F"})


@register("anti_exists", """
SELECT c_custkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")
def q_anti(spark, d):
    return joins.anti_exists(T(spark, d, "customer"), T(spark, d, "orders"), ("c_custkey", "o_custkey"),
                             other_conds={"o_orderpriority": "1-URGENT"}).select("c_custkey")


@register("cross_segment", """
SELECT c.c_custkey, c.c_name, a.c_acctbal, o.n_orders
FROM customer c
LEFT JOIN (SELECT c_custkey, min(c_acctbal) AS c_acctbal FROM customer GROUP BY 1) a ON a.c_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
""")
def q_cross_segment(spark, d):
    c = T(spark, d, "customer")
    main = c.select("c_custkey", "c_name")
    seg_bal = c.select("c_custkey", "c_acctbal")
    seg_orders = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")) \
        .agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.cross_segment(main, {"balances": seg_bal, "order_counts": seg_orders})


@register("copy_from_previous", """
SELECT t2.c_name AS name FROM customer t1 JOIN customer t2 ON t1.c_custkey = t2.c_custkey
WHERE t1.c_mktsegment = 'AUTOMOBILE'
""")
def q_copy_prev(spark, d):
    c = T(spark, d, "customer")
    previous = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    return joins.copy_from_previous(empty(spark, "name string"), previous, c, "c_custkey", "c_name", "name")


@register("join_insert", """
SELECT o.o_orderkey AS okey, c.c_name AS cust_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment IN ('BUILDING', 'FURNITURE')
""")
def q_join_insert(spark, d):
    tables = {"orders": T(spark, d, "orders"), "customer": T(spark, d, "customer")}
    conds = [joins.JoinCondition("orders", "customer", "o_custkey", "c_custkey")]
    return joins.join_insert(empty(spark, "okey long, cust_name string"), tables, conds,
                             {"okey": "orders.o_orderkey", "cust_name": "customer.c_name"},
                             conds={"customer.c_mktsegment": ["BUILDING", "FURNITURE"]})


@register("join_update", """
SELECT c_custkey, CASE WHEN m.k IS NOT NULL THEN m.v ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN (
  SELECT o_custkey AS k, min(l_extendedprice) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'R' GROUP BY 1) m ON m.k = c_custkey
""")
def q_join_update(spark, d):
    target = T(spark, d, "customer").select("c_custkey", "c_acctbal")
    tables = {"orders": T(spark, d, "orders"), "lineitem": T(spark, d, "lineitem")}
    conds = [joins.JoinCondition("orders", "lineitem", "o_orderkey", "l_orderkey")]
    return joins.join_update(target, tables, conds, ("c_custkey", "orders.o_custkey"),
                             {"c_acctbal": "lineitem.l_extendedprice"}, conds={"lineitem.l_returnflag": "R"})


@register("add_fields", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def q_add_fields(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.add_fields(o, T(spark, d, "customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])


@register("join_on_mapping", """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def q_join_mapping(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    return joins.join_on_mapping(o, c, [{"target_col": "o_custkey", "source_col": "c_custkey"}]) \
        .select("o_orderkey", "c_name")


# ====================================================================== aggregation

@register("agg_group", """
SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity, count(l_orderkey) AS count_l_orderkey,
       avg(l_discount) AS avg_l_discount, min(l_shipdate) AS min_l_shipdate, max(l_tax) AS max_l_tax
FROM lineitem GROUP BY l_returnflag
""")
def q_agg_group(spark, d):
    return aggs.aggregate(T(spark, d, "lineitem"), ["l_returnflag"],
                          [("SUM", "l_quantity"), ("COUNT", "l_orderkey"), ("AVG", "l_discount"),
                           ("MIN", "l_shipdate"), ("MAX", "l_tax")])


@register("agg_global", """
SELECT sum(l_extendedprice) AS revenue, count(*) AS count_all FROM lineitem WHERE l_linestatus = 'O'
""")
def q_agg_global(spark, d):
    return aggs.aggregate(T(spark, d, "lineitem"), [], [("SUM", "l_extendedprice", "revenue"), ("COUNT", "*")],
                          conds={"l_linestatus": "O"})


@register("agg_passthrough", """
SELECT l_linestatus, stddev_samp(l_quantity) AS stddev_samp_l_quantity,
       count(DISTINCT l_partkey) AS count_distinct_l_partkey
FROM lineitem GROUP BY l_linestatus
""")
def q_agg_pass(spark, d):
    return aggs.aggregate(T(spark, d, "lineitem"), ["l_linestatus"],
                          [("stddev_samp", "l_quantity"), ("count_distinct", "l_partkey")])


@register("duplicate_groups", """
SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def q_dup_groups(spark, d):
    return aggs.duplicate_groups(T(spark, d, "orders"), ["o_custkey"])


@register("latest_per_group", """
SELECT o.* FROM orders o JOIN (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders GROUP BY 1) m
  ON m.k = o.o_custkey AND m.d = o.o_orderdate
""")
def q_latest(spark, d):
    return aggs.latest_per(T(spark, d, "orders"), ["o_custkey"], "o_orderdate")


@register("table_summary", """
SELECT count(*) AS rows,
       (count(o_orderkey) > 0)::INT + (count(o_custkey) > 0)::INT + (count(o_orderstatus) > 0)::INT
       + (count(o_totalprice) > 0)::INT + (count(o_orderdate) > 0)::INT + (count(o_orderpriority) > 0)::INT
       + (count(CASE WHEN o_orderstatus = 'X' THEN 1 END) > 0)::INT AS populated
FROM orders
""")
def q_summary(spark, d):
    o = T(spark, d, "orders").withColumn("never", F.when(F.col("o_orderstatus") == "X", F.lit(1)))
    return aggs.summary(o).select("rows", "populated")


# ====================================================================== key checks, validation

@register("key_check", """
WITH v AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k, count(*) AS n
           FROM orders GROUP BY 1)
SELECT 'k' AS key, sum(n) AS rows, coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS null_count,
       count(CASE WHEN k IS NOT NULL AND n > 1 THEN 1 END) AS duplicate_groups FROM v
""")
def q_key_check(spark, d):
    o = T(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_custkey")).alias("k"))
    return quality.key_check(o, "k")


@register("validate_rules", """
SELECT CASE WHEN l_returnflag IS NULL THEN 'Invalid: Null value' ELSE 'Valid' END AS validation_result_1,
       CASE WHEN l_orderkey IS NULL THEN 'Invalid: Null value'
            WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL
                                GROUP BY 1 HAVING count(*) > 1) THEN 'Invalid: Duplicate value'
            ELSE 'Valid' END AS validation_result_2,
       CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 'Invalid: Out of range' ELSE 'Valid' END
         AS validation_result_3,
       CASE WHEN coalesce(regexp_matches(l_returnflag, '^[AR]$'), false) THEN 'Valid'
            ELSE 'Invalid: Pattern mismatch' END AS validation_result_4,
       CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) THEN 'Valid'
            ELSE 'Invalid: Reference not found' END AS validation_result_5,
       'Unknown validation rule: checksum' AS validation_result_6,
       l_orderkey, l_linenumber, l_partkey, l_quantity
FROM lineitem
""")
def q_validate(spark, d):
    part = T(spark, d, "part").where(F.col("p_size") < 25)
    rules = [quality.Rule("l_returnflag", "not_null"), quality.Rule("l_orderkey", "unique"),
             quality.Rule("l_quantity", "range", {"min": 5, "max": 45}),
             quality.Rule("l_returnflag", "regex", {"pattern": "^[AR]$"}),
             quality.Rule("l_partkey", "exists_in", {"reference_table": part, "reference_field": "p_partkey"}),
             quality.Rule("l_tax", "checksum")]
    return quality.validate(T(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


def _cover_sql(columns: list[tuple[str, str]], min_cover: float) -> str:
    """Every pair of columns of different tables, each by a distinct list and a semi join."""
    parts = [f"""SELECT '{a}' AS child_table, '{ac}' AS child_column, '{b}' AS parent_table, '{bc}' AS parent_column, count(*) AS child_distinct,
  count(*) FILTER (WHERE v IN (SELECT {bc} FROM {b})) AS covered FROM (SELECT DISTINCT {ac} AS v FROM {a} WHERE {ac} IS NOT NULL)"""
             for a, ac in columns for b, bc in columns if a != b]
    return f"""SELECT *, covered / child_distinct AS cover FROM ({" UNION ALL ".join(parts)})
WHERE child_distinct > 0 AND covered / child_distinct >= {min_cover}"""


#: The columns of five tables by type: all pairs within a list are compared.
_TEXTS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"),
          ("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("nation", "n_name")]
_INTS = [("lineitem", "l_linenumber"), ("customer", "c_nationkey"), ("part", "p_size"), ("nation", "n_nationkey"), ("nation", "n_regionkey")]
_LONGS = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"),
          ("customer", "c_custkey"), ("part", "p_partkey")]


@register("find_relationships", " UNION ALL ".join(f"SELECT * FROM ({_cover_sql(c, 0.5)})" for c in (_TEXTS, _INTS, _LONGS)))
def q_relationships(spark, d):
    return quality.find_relationships({t: T(spark, d, t) for t in ("orders", "lineitem", "customer", "part", "nation")}, 0.5)


@register("profile_orders", """
SELECT 0 AS "position", 'o_orderkey' AS "column", 'bigint' AS "type", count(*) AS "rows", count(*) - count(o_orderkey) AS "nulls", count(DISTINCT o_orderkey) AS "distinct", CAST(min(o_orderkey) AS VARCHAR) AS "min", CAST(max(o_orderkey) AS VARCHAR) AS "max", avg(o_orderkey) AS "mean", stddev_samp(o_orderkey) AS "stddev" FROM orders
UNION ALL
SELECT 1 AS "position", 'o_custkey' AS "column", 'bigint' AS "type", count(*) AS "rows", count(*) - count(o_custkey) AS "nulls", count(DISTINCT o_custkey) AS "distinct", CAST(min(o_custkey) AS VARCHAR) AS "min", CAST(max(o_custkey) AS VARCHAR) AS "max", avg(o_custkey) AS "mean", stddev_samp(o_custkey) AS "stddev" FROM orders
UNION ALL
SELECT 2 AS "position", 'o_orderstatus' AS "column", 'string' AS "type", count(*) AS "rows", count(*) - count(o_orderstatus) AS "nulls", count(DISTINCT o_orderstatus) AS "distinct", CAST(min(o_orderstatus) AS VARCHAR) AS "min", CAST(max(o_orderstatus) AS VARCHAR) AS "max", CAST(NULL AS DOUBLE) AS "mean", CAST(NULL AS DOUBLE) AS "stddev" FROM orders
UNION ALL
SELECT 3 AS "position", 'o_totalprice' AS "column", 'double' AS "type", count(*) AS "rows", count(*) - count(o_totalprice) AS "nulls", count(DISTINCT o_totalprice) AS "distinct", CAST(min(o_totalprice) AS VARCHAR) AS "min", CAST(max(o_totalprice) AS VARCHAR) AS "max", avg(o_totalprice) AS "mean", stddev_samp(o_totalprice) AS "stddev" FROM orders
UNION ALL
SELECT 4 AS "position", 'o_orderdate' AS "column", 'timestamp_ntz' AS "type", count(*) AS "rows", count(*) - count(o_orderdate) AS "nulls", count(DISTINCT o_orderdate) AS "distinct", CAST(min(o_orderdate) AS VARCHAR) AS "min", CAST(max(o_orderdate) AS VARCHAR) AS "max", CAST(NULL AS DOUBLE) AS "mean", CAST(NULL AS DOUBLE) AS "stddev" FROM orders
UNION ALL
SELECT 5 AS "position", 'o_orderpriority' AS "column", 'string' AS "type", count(*) AS "rows", count(*) - count(o_orderpriority) AS "nulls", count(DISTINCT o_orderpriority) AS "distinct", CAST(min(o_orderpriority) AS VARCHAR) AS "min", CAST(max(o_orderpriority) AS VARCHAR) AS "max", CAST(NULL AS DOUBLE) AS "mean", CAST(NULL AS DOUBLE) AS "stddev" FROM orders
""")
def q_profile(spark, d):
    return quality.profile(T(spark, d, "orders"))


# ====================================================================== diffs

_DIFF_B = """(SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')"""


def _diff_b(o: DataFrame) -> DataFrame:
    return o.where(F.col("o_orderpriority") != "5-LOW").withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")))


@register("diff_rows", f"""
SELECT b.*, 'new' AS status FROM {_DIFF_B} b
WHERE NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey
  AND a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus
  AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice AND a.o_orderdate IS NOT DISTINCT FROM b.o_orderdate
  AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority)
UNION ALL
SELECT a.*, 'removed' AS status FROM orders a
WHERE NOT EXISTS (SELECT 1 FROM {_DIFF_B} b WHERE a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey
  AND a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus
  AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice AND a.o_orderdate IS NOT DISTINCT FROM b.o_orderdate
  AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority)
""")
def q_diff_rows(spark, d):
    o = T(spark, d, "orders")
    return diff.diff_rows_tagged(o, _diff_b(o))


@register("keyed_diff", """
WITH a AS (SELECT * FROM orders),
     b AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
                  o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
           UNION ALL
           SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
           FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL
   OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
   OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
   OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
""")
def q_keyed_diff(spark, d):
    o = T(spark, d, "orders")
    b = o.where(F.col("o_orderstatus") != "P").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")))
    b = b.unionByName(o.where(F.col("o_orderpriority") == "2-HIGH")
                      .withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    return diff.diff_keyed(o, b, ["o_orderkey"])


# ====================================================================== scalar functions

@register("regex_funcs", r"""
SELECT p_partkey,
       regexp_replace(p_name, '(\w+) (\w+)', '\2_\1', 'g') AS r1,
       regexp_matches(p_name, '^s') AS r2,
       CASE WHEN regexp_matches(p_name, '(\w+)$') THEN regexp_extract(p_name, '(\w+)$', 1) END AS r3,
       CASE WHEN regexp_matches(p_name, '^(x+)') THEN regexp_extract(p_name, '^(x+)', 1) END AS r4,
       regexp_replace(p_name, 'RING', 'R', 'gi') AS r5
FROM part
""")
def q_regex(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey",
                    fn.regexp_replace("p_name", r"(\w+) (\w+)", r"\2_\1").alias("r1"),
                    fn.regexp_match(r"^s", "p_name").alias("r2"),
                    fn.regexp_extract(r"(\w+)$", "p_name", 1).alias("r3"),
                    fn.regexp_extract(r"^(x+)", "p_name", 1).alias("r4"),
                    fn.regexp_replace("p_name", "RING", "R", "i").alias("r5"))


@register("string_funcs", r"""
SELECT p_partkey,
       split_part(p_name, ' ', 2) AS s1, '' AS s2, '' AS s3, p_name AS s4,
       reverse(p_name) AS s5,
       array_to_string(list_transform(regexp_extract_all(p_name || '''s 3rd o''neil-x', '(\p{L}+|[^\p{L}]+)'),
                                      lambda t: upper(t[1]) || lower(t[2:])), '') AS s6,
       CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE lpad(p_brand, 10, '*') END AS s7,
       CASE WHEN length(p_type) >= 6 THEN p_type ELSE rpad(p_type, 6, '.') END AS s8
FROM part
""")
def q_strings(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey",
                    fn.split_string("p_name", " ", 1).alias("s1"),
                    fn.split_string("p_name", " ", 5).alias("s2"),
                    fn.split_string("p_name", " ", -1).alias("s3"),
                    fn.split_string("p_name", " ").alias("s4"),
                    fn.reverse_string("p_name").alias("s5"),
                    fn.proper_case(F.concat("p_name", F.lit("'s 3rd o'neil-x"))).alias("s6"),
                    fn.left_pad("p_brand", 10, "*").alias("s7"),
                    fn.right_pad("p_type", 6, ".").alias("s8"))


_NUM_TEXT_SQL = """CASE l_linenumber WHEN 1 THEN 500.0 WHEN 2 THEN 6.0 WHEN 3 THEN 'nan'::DOUBLE
                     WHEN 4 THEN 0.0 WHEN 5 THEN 50000.0 ELSE l_quantity / 2 END"""


@register("number_funcs", f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_discount END AS n1,
       CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax * 100, 2) END AS n2,
       CASE WHEN isnan(pow(l_discount - 0.05, 0.5)) THEN 0.0 ELSE pow(l_discount - 0.05, 0.5) END AS n3,
       {_NUM_TEXT_SQL} AS n4,
       l_linenumber <> 4 AS n5
FROM lineitem
""")
def q_numbers(spark, d):
    # Numbers as text, materialised as a column first: the parsers read their
    # input many times, and a column read is cheap where a CASE is not.
    li = T(spark, d, "lineitem").withColumn("txt", (
        F.when(F.col("l_linenumber") == 1, "1_000").when(F.col("l_linenumber") == 2, " 12 ")
        .when(F.col("l_linenumber") == 3, "nan").when(F.col("l_linenumber") == 4, "1d")
        .when(F.col("l_linenumber") == 5, "1e5").otherwise(F.col("l_quantity").cast("string"))))
    txt = F.col("txt")
    return li.select("l_orderkey", "l_linenumber",
                     fn.safe_divide("l_extendedprice", "l_discount").alias("n1"),
                     fn.percentage("l_discount", "l_tax").alias("n2"),
                     fn.power_of(F.col("l_discount") - 0.05, 0.5).alias("n3"),
                     fn.safe_divide(txt, 2).alias("n4"),
                     fn.is_numeric(txt).alias("n5"))


def _dirty_date(bad: str):
    return F.when(F.col("o_orderpriority") == "5-LOW", F.lit(bad)).otherwise(fn.date_text("o_orderdate"))


@register("date_funcs", """
SELECT o_orderkey,
       CASE WHEN o_orderpriority = '5-LOW' THEN '20230230'
            ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') END AS f1,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE date_diff('day', o_orderdate, DATE '2000-01-01') END AS f2,
       CASE WHEN o_orderpriority = '5-LOW' THEN '20230230' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS f3,
       CASE WHEN o_orderpriority = '5-LOW' THEN '2023-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS f4,
       CASE WHEN o_orderpriority = '5-LOW' THEN '20230230' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS f5,
       CASE WHEN length(o_orderkey::VARCHAR) >= 10 THEN o_orderkey::VARCHAR
            ELSE lpad(o_orderkey::VARCHAR, 10, '0') END AS f6,
       CASE WHEN o_orderpriority = '5-LOW' THEN '20230230' ELSE strftime(o_orderdate, '%d %B %Y') END AS f7,
       year(o_orderdate) || '-11-0' || (1 + o_orderkey % 9) AS f8, '0' || (1 + o_orderkey % 9) || '.01.' || year(o_orderdate) AS f9
FROM orders
""")
def q_dates(spark, d):
    o = T(spark, d, "orders").withColumn("dt", _dirty_date("20230230"))
    return o.select("o_orderkey",
                    fn.date_add_days("dt", 30, "%Y%m%d").alias("f1"),
                    fn.date_diff_days("dt", F.lit("20000101"), "%Y%m%d").alias("f2"),
                    fn.format_date("dt").alias("f3"),
                    fn.yyyymmdd_to_iso("dt").alias("f4"),
                    fn.convert_sap_date("dt", "DD.MM.YYYY").alias("f5"),
                    fn.leading_zeros("o_orderkey", 10).alias("f6"),
                    fn.format_date("dt", "%Y%m%d", "%d %B %Y").alias("f7"),
                    # One digit too few: November or January and a day of one digit.
                    fn.format_date(F.concat(F.year("o_orderdate"), F.lit("11"), 1 + F.col("o_orderkey") % 9)).alias("f8"),
                    fn.convert_sap_date(F.concat(F.year("o_orderdate"), F.lit("01"), 1 + F.col("o_orderkey") % 9), "DD.MM.YYYY").alias("f9"))


@register("json_funcs", """
SELECT event_id,
       CASE WHEN event_type IN ('error', 'view') THEN '' ELSE coalesce(json_extract_string(props, '$.k'), '') END AS j1,
       '' AS j2,
       event_type <> 'error' AS j3
FROM events
""")
def q_json(spark, d):
    e = T(spark, d, "events")
    j = (F.when(F.col("event_type") == "error", F.lit("{bad"))
         .when(F.col("event_type") == "view", F.lit("[1, 2]")).otherwise(F.col("props")))
    return e.select("event_id", fn.json_extract_value(j, "k").alias("j1"),
                    fn.json_extract_value(j, "missing").alias("j2"), fn.is_valid_json(j).alias("j3"))


_NUMERIC_RE2 = (r"^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.(?:\d+(?:_\d+)*))"
                r"(?:[eE][+-]?\d+(?:_\d+)*)?$")


@register("text_checks", rf"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS tok FROM documents)
SELECT doc_id,
       sum(CASE WHEN regexp_matches(tok, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') THEN 1 ELSE 0 END)::BIGINT
         AS emails,
       sum(CASE WHEN length(regexp_replace(tok, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 THEN 1 ELSE 0 END)::BIGINT
         AS phones,
       sum(CASE WHEN regexp_matches(tok, '{_NUMERIC_RE2}')
                  OR regexp_matches(tok, '(?i)^[+-]?(?:inf|infinity|nan)$') THEN 1 ELSE 0 END)::BIGINT AS numerics
FROM t GROUP BY doc_id
""")
def q_text_checks(spark, d):
    # Whole texts; the tokens are counted inside their text, so nothing is split or shuffled.
    return T(spark, d, "documents").select("doc_id", *(fn.count_tokens("text", kind).alias(f"{kind}s") for kind in ("email", "phone", "numeric")))


@register("sqlite_builtins", r"""
SELECT p_partkey, log10(p_retailprice) AS b1,
       coalesce(TRY_CAST(regexp_extract(trim(substr(p_brand, 7)), '^[+-]?\d+', 0) AS BIGINT), 0) AS b2,
       0::BIGINT AS b3, p_name || '-' || p_type AS b4, p_size // 3 AS b5
FROM part
""")
def q_builtins(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", fn.sqlite_log("p_retailprice").alias("b1"),
                    fn.sqlite_int(F.expr("substring(p_brand, 7)")).alias("b2"),
                    fn.sqlite_int("p_name").alias("b3"),
                    fn.concat_op(F.col("p_name"), "-", F.col("p_type")).alias("b4"),
                    fn.sqlite_div("p_size", F.lit(3)).alias("b5"))


# ====================================================================== column patterns

@register("clean_special_chars", """
SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS cleaned FROM documents
""")
def q_clean(spark, d):
    return T(spark, d, "documents").select("doc_id", fn.clean_special_characters("text").alias("cleaned"))


@register("string_patterns", """
SELECT p_partkey,
       CASE WHEN length(p_name) - length(replace(p_name, ' ', '')) = 0 THEN p_name
            ELSE substr(substr(p_name, instr(p_name, ' ') + 1), 1, 3) END AS short_name,
       length(p_name) AS name_len,
       CASE WHEN length(p_name) > 9 THEN 'LONG' ELSE 'SHORT' END AS name_class
FROM part
""")
def q_string_patterns(spark, d):
    p = T(spark, d, "part")
    n, flag = fn.length_flag("p_name", 9, "LONG", "SHORT")
    return p.select("p_partkey", fn.after_first_word("p_name", 3).alias("short_name"),
                    n.alias("name_len"), flag.alias("name_class"))


@register("date_patterns", """
WITH o AS (SELECT *, o_orderpriority = '5-LOW' AS bad,
                  CASE WHEN o_orderpriority = '5-LOW' THEN '20231301' ELSE strftime(o_orderdate, '%Y%m%d') END AS dt
           FROM orders)
SELECT o_orderkey,
       substr(dt, 5, 2) AS part_5_2, substr(dt, 7, 2) AS day, substr(dt, 5, 2) AS month, substr(dt, 1, 4) AS year,
       CASE WHEN TRY_CAST(substr(dt, 5, 2) AS INTEGER) BETWEEN 1 AND 3 THEN 'Q1'
            WHEN TRY_CAST(substr(dt, 5, 2) AS INTEGER) BETWEEN 4 AND 6 THEN 'Q2'
            WHEN TRY_CAST(substr(dt, 5, 2) AS INTEGER) BETWEEN 7 AND 9 THEN 'Q3' ELSE 'Q4' END AS quarter,
       CASE WHEN bad THEN NULL ELSE dayname(o_orderdate) END AS day_name,
       CASE WHEN bad THEN NULL ELSE strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') END
         AS prev_month_end,
       '2024-01-31' AS run_date,
       CASE WHEN bad THEN NULL ELSE dayofweek(o_orderdate)::VARCHAR END AS weekday_num,
       CASE WHEN bad THEN NULL ELSE strftime(o_orderdate, '%B %d, %Y') END AS readable
FROM o
""")
def q_date_patterns(spark, d):
    o = T(spark, d, "orders").withColumn("dt", _dirty_date("20231301"))
    return o.select("o_orderkey",
                    fn.date_part_by_position("dt", 5, 2).alias("part_5_2"),
                    fn.date_component("dt", "day").alias("day"),
                    fn.date_component("dt", "month").alias("month"),
                    fn.date_component("dt", "year").alias("year"),
                    fn.date_component("dt", "quarter").alias("quarter"),
                    fn.date_component("dt", "day_name").alias("day_name"),
                    fn.prev_month_end("dt").alias("prev_month_end"),
                    fn.system_date("2024-01-31").alias("run_date"),
                    fn.weekday_number("dt").alias("weekday_num"),
                    fn.readable_date("dt").alias("readable"))


# ====================================================================== fuzzy resolution (rows-only)

def part_name_typos(spark, d) -> DataFrame:
    """Part names with made-up typos, derived in Spark from the part table:
    key % 4 = 0 unchanged, 1 one character dropped, 2 one character replaced
    by 'x', 3 an extra 'q' inserted."""
    p = T(spark, d, "part").select("p_partkey", "p_name")
    n = F.length("p_name")
    pos = (F.col("p_partkey") % F.greatest(n, F.lit(1))).cast("int") + 1
    k = F.col("p_partkey") % 4
    drop = F.concat(F.substring("p_name", 1, pos - 1), F.expr("substring(p_name, " "cast(p_partkey % greatest(length(p_name), 1) as int) + 2)"))
    repl = F.concat(F.substring("p_name", 1, pos - 1), F.lit("x"),
                    F.expr("substring(p_name, cast(p_partkey % greatest(length(p_name), 1) as int) + 2)"))
    ins = F.concat(F.substring("p_name", 1, 3), F.lit("q"), F.expr("substring(p_name, 4)"))
    typo = F.when(k == 0, F.col("p_name")).when(k == 1, drop).when(k == 2, repl).otherwise(ins)
    return p.select("p_partkey", typo.alias("typo_name"))


@register("fuzzy_part_names")
def q_fuzzy(spark, d):
    from tablewright.operators import fuzzy
    typos = part_name_typos(spark, d)
    names = T(spark, d, "part").select("p_name", "p_partkey")
    return fuzzy.fuzzy_best(typos, "typo_name", names, "p_name", 0.6, "p_partkey")


@register("resolve_part_names")
def q_resolve(spark, d):
    from tablewright.operators import fuzzy
    typos = part_name_typos(spark, d)
    names = T(spark, d, "part").select("p_name", "p_partkey")
    return fuzzy.resolve_names(typos, "typo_name", names, "p_name", 0.4, "p_partkey")


# ====================================================================== request / statement classifiers

@register("clean_table_names", r"""
SELECT p_partkey, regexp_replace(p_type || CASE WHEN p_size % 2 = 0 THEN ' Table' ELSE '_table' END,
                                 '[ _](Table|table|TABLE)$', '') AS clean
FROM part
""")
def q_clean_names(spark, d):
    from tablewright.plans.requests import clean_name
    p = T(spark, d, "part")
    raw = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, F.lit(" Table")).otherwise(F.lit("_table")))
    return p.select("p_partkey", clean_name(raw).alias("clean"))


# ====================================================================== reports

@register("pre_post_report", """
SELECT t.c_custkey AS primary_key, s.c_name AS c_name_source, t.c_name AS c_name_target,
       t.c_acctbal AS c_acctbal_source, t.c_acctbal AS c_acctbal_target,
       NULL AS src_source, t.src AS src_target
FROM (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal, 'ERP' AS src FROM customer) t
LEFT JOIN customer s ON s.c_custkey = t.c_custkey
ORDER BY 1
""")
def q_report(spark, d):
    from tablewright.plans.lineage import pre_post_report
    from tablewright.plans.steps import ColumnLineage
    c = T(spark, d, "customer")
    target = c.select("c_custkey", F.upper("c_name").alias("c_name"), "c_acctbal", F.lit("ERP").alias("src"))
    cols = [ColumnLineage("c_name", "customer", "c_name", "string_manipulation"),
            ColumnLineage("c_acctbal", "customer", "c_acctbal"),
            ColumnLineage("src")]
    return pre_post_report(target, {"customer": c}, cols, "c_custkey")


@register("sync_check", """
SELECT (SELECT count(*) FROM customer) AS target_row_count,
       (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS source_row_count,
       (SELECT count(*) FROM customer) = (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING')
         AS row_counts_match,
       true AS schemas_match,
       (SELECT count(*) FROM customer) = (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING')
         AS in_sync
""")
def q_sync(spark, d):
    from tablewright.plans.lineage import sync_check
    c = T(spark, d, "customer")
    return sync_check(c, c.where(F.col("c_mktsegment") != "BUILDING"))


@register("selection_load", """
SELECT c_custkey AS cust_id, c_name AS cust_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
""")
def q_selection_load(spark, d):
    from tablewright.plans.runs import selection_load
    target = empty(spark, "cust_id long, cust_name string")
    new_target, _ = selection_load(target, T(spark, d, "customer"), {"cust_id": "c_custkey", "cust_name": "c_name"},
                                   {"c_mktsegment": "HOUSEHOLD"})
    return new_target


@register("check_result", """
SELECT (SELECT count(*) FROM customer) AS target_rows, count(*) AS result_rows,
       (SELECT count(*) FROM customer) >= count(*) AS rows_ok,
       'c_custkey,c_name' AS populated_columns, true AS columns_ok
FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_check_result(spark, d):
    c = T(spark, d, "customer")
    result = c.where(F.col("c_mktsegment") == "BUILDING").select(
        "c_custkey", "c_name", F.when(F.col("c_mktsegment") == "X", F.lit(1)).alias("never"))
    out = quality.check_result(c, result, ["c_custkey", "c_name"])
    return out.withColumn("populated_columns", F.array_join("populated_columns", ","))


# ---------------------------------------------------------------- M6-M8 over dictionaries derived from the tables

@register("glossary_part_brands")
def q_glossary(spark, d):
    """M7: glossary description = part name, field = brand; mentions = the
    part names with typos; database columns = the supplier names."""
    from tablewright.operators import fuzzy
    glossary = T(spark, d, "part").select(F.col("p_partkey").alias("field_id"), F.col("p_name").alias("description"),
                                          F.col("p_brand").alias("target_sap_field"))
    mentions = part_name_typos(spark, d).select("typo_name").distinct()
    db_cols = T(spark, d, "supplier").select(F.col("s_name").alias("column_name"))
    return fuzzy.glossary_match(mentions, "typo_name", glossary, db_cols)


@register("two_pass_part_columns")
def q_two_pass(spark, d):
    """M6: "tables" = part types, their "columns" = part names (ordered by key);
    mentions = part names with typos."""
    from tablewright.operators import fuzzy
    cols = T(spark, d, "part").groupBy(F.col("p_type").alias("table_name"), F.col("p_name").alias("column_name")) \
        .agg(F.min("p_partkey").alias("column_order"))
    cols = cols.withColumn("table_order", F.xxhash64("table_name"))
    mentions = part_name_typos(spark, d).select("typo_name").distinct()
    return fuzzy.match_two_pass(mentions, "typo_name", cols)


@register("segment_match_nations")
def q_segments(spark, d):
    """M8: segments = nations (name -> per-region target tables); mentions =
    the customers' nation written as free text."""
    from tablewright.operators import fuzzy
    n = T(spark, d, "nation")
    segs = n.select(F.col("n_nationkey").alias("segment_id"), F.col("n_name").alias("segement_name"),
                    F.concat(F.lit("t_"), F.col("n_regionkey"), F.lit("_"), F.lower("n_name")).alias("table_name"))
    mentions = T(spark, d, "customer").select(
        F.concat(F.lit("nation "), F.col("c_nationkey")).alias("mention")).distinct()
    return fuzzy.segment_match(mentions, "mention", segs, current_prefix="t_1")


# ---------------------------------------------------------------- keys named in the survey's oracle sketch

@register("quarter_of", """
SELECT o_orderkey,
       CASE WHEN month(o_orderdate) BETWEEN 1 AND 3 THEN 'Q1' WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 'Q2'
            WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 'Q3' ELSE 'Q4' END AS quarter
FROM orders
""")
def q_quarter_of(spark, d):
    return T(spark, d, "orders").select("o_orderkey", fn.quarter_of(fn.date_text("o_orderdate")).alias("quarter"))


@register("weekday_num", """
SELECT o_orderkey, dayofweek(o_orderdate)::VARCHAR AS weekday_num FROM orders
""")
def q_weekday_num(spark, d):
    return T(spark, d, "orders").select("o_orderkey", fn.weekday_number(fn.date_text("o_orderdate")).alias("weekday_num"))


@register("prev_month_end", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS prev_month_end
FROM orders
""")
def q_prev_month_end(spark, d):
    return T(spark, d, "orders").select("o_orderkey", fn.prev_month_end(fn.date_text("o_orderdate")).alias("prev_month_end"))


@register("readable_date", """
SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS readable_date FROM orders
""")
def q_readable_date(spark, d):
    return T(spark, d, "orders").select("o_orderkey", fn.readable_date(fn.date_text("o_orderdate")).alias("readable_date"))


@register("json_value", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events
""")
def q_json_value(spark, d):
    return T(spark, d, "events").select("event_id", fn.json_extract_value("props", "k").alias("k"))


@register("sql_surface", """
SELECT c_custkey, reverse(c_name) AS rev,
       CASE WHEN length(CAST(c_nationkey AS VARCHAR)) >= 3 THEN CAST(c_nationkey AS VARCHAR)
            ELSE lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS nk,
       CASE WHEN c_nationkey = 0 THEN 0.0 ELSE c_acctbal / c_nationkey END AS per_nation,
       split_part(c_name, '#', 2) AS num,
       CASE WHEN c_acctbal < 0 THEN 0.0 ELSE pow(c_acctbal, 0.5) END AS root
FROM customer
""")
def q_sql_surface(spark, d):
    """The reference's SQL function names used from ``spark.sql`` (SQL-bodied
    functions, inlined into the plan) over the whole customer table."""
    fn.register_sql_functions(spark)
    T(spark, d, "customer").createOrReplaceTempView("tw_customer")
    return spark.sql("""
        SELECT c_custkey, reverse_string(c_name) AS rev, left_pad(CAST(c_nationkey AS STRING), 3, '0') AS nk,
               safe_divide(c_acctbal, c_nationkey) AS per_nation, split_string(c_name, '#', 1) AS num,
               power_of(c_acctbal, 0.5) AS root
        FROM tw_customer""")


# Further queries, over statements and runs built from the given tables.
from tablewright.plans import engine_queries, name_queries  # noqa: E402,F401
