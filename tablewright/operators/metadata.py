"""Field-mapping metadata (M1-M2): resolve and clean the mapping of one
(object, segment, project) from the ``connection_fields`` / ``connection_rule``
/ ``connection_segments`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggs import latest_per


def resolve_mapping(fields: DataFrame, rules: DataFrame, segments: DataFrame,
                    obj_id: int, segment_id: int, project_id: int) -> DataFrame:
    """M1: fields of the (object, segment, project), LEFT JOIN the newest rule
    version per field (all tied newest versions kept), JOIN the segment on its
    three keys.  Filters sit on each scan, so they reach the readers."""
    f = fields.where((F.col("obj_id_id") == obj_id) & (F.col("segement_id_id") == segment_id)
                     & (F.col("project_id_id") == project_id))
    r = rules.where((F.col("object_id_id") == obj_id) & (F.col("segment_id_id") == segment_id)
                    & (F.col("project_id_id") == project_id))
    r = latest_per(r, ["field_id"], "version_id").select(
        F.col("field_id").alias("__r_field_id"), "source_field_name", "target_sap_field")
    s = segments.select(F.col("segment_id").alias("__s_seg"), F.col("obj_id_id").alias("__s_obj"),
                        F.col("project_id_id").alias("__s_proj"), "table_name")
    out = f.join(r, f["field_id"] == r["__r_field_id"], "left")
    out = out.join(s, (out["segement_id_id"] == s["__s_seg"]) & (out["obj_id_id"] == s["__s_obj"])
                   & (out["project_id_id"] == s["__s_proj"]), "inner")
    return out.select("field_id", "fields", "description", "isMandatory", "isKey", "source_table",
                      "source_field_name", "target_sap_field", "table_name")


def _blank_to_null(c: str):
    return F.when(F.col(c).rlike(r"^\s*$"), F.lit(None)).otherwise(F.col(c))


def clean_mapping(df: DataFrame, order_col: str = "field_id") -> DataFrame:
    """M2: blank -> NULL; empty ``source_table`` filled with the first non-NULL
    one (first by ``order_col``: a deterministic order, computed as one global
    aggregate, not a collect); missing ``source_field_name`` taken from
    ``target_sap_field``."""
    out = df.withColumn("source_table", _blank_to_null("source_table")) \
        .withColumn("source_field_name", _blank_to_null("source_field_name")) \
        .withColumn("target_sap_field", _blank_to_null("target_sap_field"))
    # One value (the first non-blank source table) is read back to the driver:
    # a single scalar from a global aggregate, bounded whatever the table size.
    first = out.where(F.col("source_table").isNotNull()) \
        .agg(F.min_by("source_table", order_col).alias("s")).first()["s"]
    out = out.withColumn("source_table", F.coalesce(F.col("source_table"), F.lit(first).cast("string")))
    return out.withColumn("source_field_name", F.coalesce("source_field_name", "target_sap_field"))
