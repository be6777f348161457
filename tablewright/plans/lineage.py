"""Column lineage (R4) and the pre/post-load report (R3), sync check."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators._keys import dedupe_by_key, keyed_left_join
from tablewright.plans.steps import ColumnLineage, Step

LINEAGE_SCHEMA = ("session_id string, step string, step_index int, target_table string, target_column string, "
                  "source_table string, source_column string, qualified_name string, "
                  "transformation_applied boolean, transformation_type string")


def lineage(spark: SparkSession, steps: Sequence[Step], target_table: str, session_id: str = "") -> DataFrame:
    """One row per (step, target column) from the declared step specs.
    The spec list is small driver-side metadata (one row per declared column)."""
    rows = []
    for i, st in enumerate(steps):
        for cl in st.lineage:
            qn = f"{cl.source_table}.{cl.source_column}" if cl.source_table and cl.source_column else None
            rows.append((session_id, st.name, i + 1, target_table, cl.target_column, cl.source_table,
                         cl.source_column, qn, cl.transformed, cl.transformation_type))
    return spark.createDataFrame(rows, LINEAGE_SCHEMA)


def lineage_counts(rows: DataFrame, target: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Lineage rows with what the tables hold: ``filled`` (non-NULL values of the
    target column) and ``source_filled`` (of its source column; NULL for a
    constant).  One aggregate a table; a table's counts are one row a column."""
    def filled(df: DataFrame, table: str | None) -> DataFrame:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(table).cast("string").alias("__t"), F.lit(c).alias("__c"), F.col(f"n{i}").alias("__n"))
                                                for i, c in enumerate(df.columns)])))
    of_target = filled(target, None).select(F.col("__c").alias("__tc"), F.col("__n").alias("filled"))
    out = rows.join(of_target, F.col("target_column") == F.col("__tc"), "left").drop("__tc")
    known = None
    for name, df in sources.items():
        known = filled(df, name) if known is None else known.unionByName(filled(df, name))
    if known is None:
        return out.withColumn("source_filled", F.lit(None).cast("long"))
    known = known.withColumnRenamed("__n", "source_filled")
    return out.join(known, (F.col("source_table") == F.col("__t")) & (F.col("source_column") == F.col("__c")), "left").drop("__t", "__c")


def pre_post_report(target: DataFrame, sources: Mapping[str, DataFrame], columns: Sequence[ColumnLineage],
                    key: str, source_keys: Mapping[str, str] | None = None) -> DataFrame:
    """``primary_key`` then, per lineage column, ``<col>_source`` and
    ``<col>_target``: a transformed column shows the source table's value
    (LEFT JOIN on the key, source reduced to one row per key, hot keys split); an untouched one
    shows the target value twice; a constant (no source) shows NULL.  Ordered
    by key (a range-partitioned sort, distributed)."""
    out = target.select(F.col(key).alias("primary_key"), *[F.col(c).alias(f"__t_{c}") for c in target.columns])
    joined_tables: dict[str, str] = {}
    src_cols: dict[str, list[str]] = {}
    for cl in columns:
        if cl.source_table and cl.transformed:
            src_cols.setdefault(cl.source_table, [])
            if cl.source_column not in src_cols[cl.source_table]:
                src_cols[cl.source_table].append(cl.source_column)
    for i, (tab, cols) in enumerate(src_cols.items()):
        sk = (source_keys or {}).get(tab, key)
        s = sources[tab].select(F.col(sk).alias(f"__k{i}"), *[F.col(c).alias(f"__s{i}_{c}") for c in cols])
        s = dedupe_by_key(s, [f"__k{i}"], [f"__s{i}_{c}" for c in cols])
        out = keyed_left_join(out, s, [("primary_key", f"__k{i}")], flag=None)
        joined_tables[tab] = f"__s{i}_"
    sel = [F.col("primary_key")]
    for cl in columns:
        c = cl.target_column
        if cl.source_table and cl.source_column:
            src = (F.col(joined_tables[cl.source_table] + cl.source_column) if cl.transformed
                   else F.col(f"__t_{c}"))
        else:
            src = F.lit(None)
        tgt = F.col(f"__t_{c}") if c in target.columns else F.lit(None)
        sel += [src.alias(f"{c}_source"), tgt.alias(f"{c}_target")]
    return out.select(*sel).orderBy("primary_key")


def sync_check(target: DataFrame, src: DataFrame) -> DataFrame:
    """One row: row counts, schema equality and ``in_sync``.  Both counts
    come from one aggregate over a tagged union of the key-less rows."""
    same_schema = [(f.name, f.dataType.simpleString()) for f in target.schema.fields] == \
                  [(f.name, f.dataType.simpleString()) for f in src.schema.fields]
    tagged = target.select(F.lit(1).alias("__t")).unionByName(src.select(F.lit(0).alias("__t")))
    row = tagged.agg(F.coalesce(F.sum("__t"), F.lit(0)).cast("long").alias("target_row_count"),
                     F.coalesce(F.sum(1 - F.col("__t")), F.lit(0)).cast("long").alias("source_row_count"))
    return row.select(
        "target_row_count", "source_row_count",
        (F.col("target_row_count") == F.col("source_row_count")).alias("row_counts_match"),
        F.lit(same_schema).alias("schemas_match"),
        ((F.col("target_row_count") == F.col("source_row_count")) & F.lit(same_schema)).alias("in_sync"))
