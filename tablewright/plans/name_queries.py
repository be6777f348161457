"""Registered name-resolution queries whose outcome SQL can state.

Mentions are customer names, so the dictionary grows with the data: by the key,
a name keeps its form, is put in capitals, gets blanks around it, or becomes a run
of tildes, which shares no character with any name.  So each mention has an equal
entry or none that could match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import fuzzy
from tablewright.plans.registry import T, register

_MENTION = ("CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) WHEN 2 THEN concat('  ', lower(c_name), ' ') "
            "ELSE repeat('~', CAST(3 + c_custkey % 20 AS INT)) END")
_TILDES = "c_custkey % 4 = 3"


def _mentions(spark, d) -> DataFrame:
    return T(spark, d, "customer").select("c_custkey", "c_name", F.expr(_MENTION).alias("mention"))


@register("match_customer_names", f"""
SELECT c_custkey, CASE WHEN NOT {_TILDES} THEN c_name END AS match, CASE WHEN {_TILDES} THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM customer
""")
def q_match(spark, d):
    """M4: the best match alone, no count of matches."""
    names = T(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("place"))
    found = fuzzy.fuzzy_best(_mentions(spark, d), "mention", names, "name", 0.6, "place", count_matches=False)
    return found.select("c_custkey", "match", "score")


@register("resolve_customer_names", f"""
SELECT c_custkey, CASE WHEN {_TILDES} THEN {_MENTION} ELSE c_name END AS resolved, CASE WHEN {_TILDES} THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
FROM customer
""")
def q_resolve(spark, d):
    """M5: equal names are certain, names without any match stay as they are."""
    names = T(spark, d, "customer").select("c_name", "c_custkey")
    found = fuzzy.resolve_names(_mentions(spark, d).drop("c_name"), "mention", names, "c_name", 0.4, "c_custkey")
    return found.select("c_custkey", "resolved", "confidence")


@register("two_pass_customer_columns", f"""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS matched_column,
       CASE WHEN c_custkey % 4 = 0 THEN 'exact' ELSE 'missing' END AS match_type, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
FROM customer WHERE c_custkey % 4 IN (0, 3)
""")
def q_two_pass(spark, d):
    """M6: nations are the tables, the names of their customers the columns."""
    columns = T(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("table_name"), F.col("c_nationkey").alias("table_order"),
                                             F.col("c_name").alias("column_name"), F.col("c_custkey").alias("column_order"))
    found = fuzzy.match_two_pass(_mentions(spark, d).where("c_custkey % 4 IN (0, 3)").drop("c_name"), "mention", columns)
    return found.select("c_custkey", "matched_column", "match_type", "confidence")


@register("glossary_customer_names", f"""
SELECT {_MENTION} AS mention, c_mktsegment AS actual_column, CAST(NULL AS VARCHAR) AS matched_glossary_term, 'direct_glossary' AS match_type, 1.0::DOUBLE AS confidence
FROM customer WHERE c_custkey % 4 IN (1, 2)
""")
def q_glossary(spark, d):
    """M7: database columns drop out, equal descriptions are direct hits."""
    c = T(spark, d, "customer")
    glossary = c.select(F.col("c_custkey").alias("field_id"), F.col("c_name").alias("description"), F.col("c_mktsegment").alias("target_sap_field"))
    found = fuzzy.glossary_match(_mentions(spark, d), "mention", glossary, c.select(F.col("c_name").alias("column_name")))
    return found.select("mention", "actual_column", "matched_glossary_term", "match_type", "confidence")


@register("segment_customer_names", f"""
SELECT DISTINCT {_MENTION} AS mention, CASE WHEN {_TILDES} THEN {_MENTION} ELSE c_name END AS matched_segment,
       CASE WHEN NOT {_TILDES} THEN t || lower(c_name) END AS table_name
FROM customer, (VALUES ('t_24_'), ('t_25_')) v(t)
WHERE t = 't_24_' OR c_custkey % 3 = 0
""")
def q_segment(spark, d):
    """M8: each name is a segment of the tables t_24 and t_25; of segments with
    a table t_24 only that stays, others (key divisible by 3) keep both."""
    c = T(spark, d, "customer")
    prefixes = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("t_24_"), F.lit("t_25_"))).otherwise(F.array(F.lit("t_24_"), F.lit("x_25_")))
    segments = c.select(F.col("c_custkey").alias("segment_id"), F.col("c_name").alias("segement_name"), F.explode(prefixes).alias("p"))
    segments = segments.withColumn("table_name", F.concat("p", F.lower("segement_name")))
    return fuzzy.segment_match(_mentions(spark, d), "mention", segments, current_prefix="t_2").select(
        F.col("mention"), "matched_segment", "table_name")
