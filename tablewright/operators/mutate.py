"""Target-table mutation (C1-C14): every statement is ``DataFrame -> DataFrame``.

The reference mutates a SQLite table in place; here each step returns a new
DataFrame (a new logical plan) and ``plans.runs`` materialises versions.
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from tablewright.operators._keys import (MATCH, dedupe_by_key, key_pairs, keyed_left_join,
                                         maybe_broadcast)
from tablewright.operators.filters import condition, literal_like, where


class ColumnExists(ValueError):
    """ADD COLUMN of a column that is already there (not retryable, R12)."""


def _expr(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def align_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """Cast/complete ``df`` to the target's columns and types (missing -> NULL).
    A text that has no value of the target's type becomes NULL (S5)."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.schema.fields])


def insert_select(target: DataFrame, source: DataFrame, mapping: Mapping[str, str | Column],
                  conds: Mapping[str, Any] | Column | None = None) -> DataFrame:
    """``INSERT INTO target (cols) SELECT ... FROM source WHERE ...``.

    ``mapping`` is target column -> source column/expression; target columns not
    listed are NULL (SURVEY S16); new target columns are appended as in
    ``unionByName(allowMissingColumns=True)``.  A narrow union: no shuffle."""
    rows = where(source, conds).select(*[_expr(v).alias(k) for k, v in mapping.items()])
    extra = [k for k in mapping if k not in target.columns]
    base = target
    for k in extra:
        base = base.withColumn(k, F.lit(None).cast(rows.schema[k].dataType))
    return base.unionByName(align_to(rows, base), allowMissingColumns=False)


def update_from(target: DataFrame, source: DataFrame, key, columns: Mapping[str, str | Column],
                conds: Mapping[str, Any] | Column | None = None, order: str | Column | None = None,
                pick: str = "min", broadcast_max_rows: int | None = None,
                assume_unique: bool = False, split_hot: bool = True) -> DataFrame:
    """``UPDATE target SET c = q.v FROM (SELECT ... WHERE conds) q WHERE key``.

    Unmatched target rows keep their value; a matched NULL overwrites (S2).
    Several source rows per key resolve deterministically (S3): smallest value
    tuple, or the row picked by ``order``.  The de-duplicated source is unique
    per key, so the join cannot multiply target rows; skewed target keys are
    split by AQE, and a checked-small source may be broadcast."""
    pairs = key_pairs(key)
    src = where(source, conds)
    vals = {f"__tw_u_{i}": _expr(v) for i, v in enumerate(columns.values())}
    src = src.select(*[F.col(sk) for _, sk in pairs], *[c.alias(n) for n, c in vals.items()],
                     *([order.alias("__tw_o")] if isinstance(order, Column) else
                       [F.col(order).alias("__tw_o")] if isinstance(order, str) else []))
    src = dedupe_by_key(src, [sk for _, sk in pairs], list(vals),
                        order="__tw_o" if order is not None else None, pick=pick, assume_unique=assume_unique)
    src = maybe_broadcast(src, broadcast_max_rows)
    joined = keyed_left_join(target, src, pairs, split_hot=split_hot)
    matched = F.col(MATCH).isNotNull()
    out_cols = []
    names = list(vals)
    tcols = list(columns)
    for f in target.columns:
        if f in columns:
            n = names[tcols.index(f)]
            out_cols.append(F.when(matched, F.col(n).try_cast(target.schema[f].dataType))
                            .otherwise(F.col(f)).alias(f))
        else:
            out_cols.append(F.col(f))
    for t in tcols:
        if t not in target.columns:
            out_cols.append(F.col(names[tcols.index(t)]).alias(t))
    return joined.select(*out_cols)


def lookup(target: DataFrame, source: DataFrame, key, src_col: str | Column, dst_col: str,
           conds: Mapping[str, Any] | Column | None = None, pick: str = "min",
           broadcast_max_rows: int | None = None, assume_unique: bool = False, split_hot: bool = True) -> DataFrame:
    """``UPDATE t SET dst = (SELECT src_col FROM s WHERE s.k = t.k)``:
    every row is rewritten, unmatched rows become NULL (S1); several matches ->
    smallest value (S3)."""
    pairs = key_pairs(key)
    src = where(source, conds).select(*[F.col(sk) for _, sk in pairs], _expr(src_col).alias("__tw_val"))
    src = dedupe_by_key(src, [sk for _, sk in pairs], ["__tw_val"], pick=pick, assume_unique=assume_unique)
    src = maybe_broadcast(src, broadcast_max_rows)
    joined = keyed_left_join(target, src, pairs, flag=None, split_hot=split_hot)
    cols = [F.col("__tw_val").alias(dst_col) if c == dst_col else F.col(c) for c in target.columns]
    if dst_col not in target.columns:
        cols.append(F.col("__tw_val").alias(dst_col))
    return joined.select(*cols)


def upsert_mode(target: DataFrame, mode: str | None = None) -> str:
    """C4: explicit mode wins; otherwise INSERT into an empty target, else UPDATE.
    (``isEmpty`` reads at most one row.)"""
    if mode:
        if mode not in ("insert", "update"):
            raise ValueError("mode must be 'insert' or 'update'")
        return mode
    return "insert" if target.isEmpty() else "update"


def apply_mapping(target: DataFrame, source: DataFrame, mapping: Mapping[str, str | Column],
                  key=None, conds=None, mode: str | None = None, **kw) -> DataFrame:
    """Insert the mapped rows into an empty target, else update by key."""
    m = upsert_mode(target, mode)
    if m == "insert":
        return insert_select(target, source, mapping, conds)
    if key is None:
        raise ValueError("an update needs a key")
    return update_from(target, source, key, mapping, conds, **kw)


def set_default(df: DataFrame, column: str, value: Any) -> DataFrame:
    """``UPDATE t SET c = value`` for all rows."""
    v = value if isinstance(value, Column) else F.lit(value)
    if column in df.columns:
        v = v.cast(df.schema[column].dataType) if not isinstance(value, Column) else v
    return df.withColumn(column, v)


def clear(df: DataFrame, column: str) -> DataFrame:
    """``UPDATE t SET c = NULL`` (type kept)."""
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def set_if(df: DataFrame, cond_col: str, cond_value: Any, dst: str, value1: Any, value2: Any) -> DataFrame:
    """``dst = CASE WHEN cond_col = v THEN v1 ELSE v2 END`` (NULL -> v2)."""
    v1 = value1 if isinstance(value1, Column) else F.lit(value1)
    v2 = value2 if isinstance(value2, Column) else F.lit(value2)
    return df.withColumn(dst, F.when(F.col(cond_col) == literal_like(cond_value, df.schema[cond_col].dataType), v1).otherwise(v2))


def update_where_prefix(df: DataFrame, column: str, prefix: str, new_value: Any) -> DataFrame:
    """``UPDATE t SET c = new WHERE c LIKE 'prefix%'`` (case-insensitive like
    SQLite, S4); other rows unchanged."""
    c = F.col(column)
    hit = F.coalesce(F.lower(c).startswith(prefix.lower()), F.lit(False))
    return df.withColumn(column, F.when(hit, F.lit(new_value).cast(df.schema[column].dataType)).otherwise(c))


def add_column(df: DataFrame, name: str, dtype: DataType | str = StringType(),
               if_exists: str = "error") -> DataFrame:
    """``ALTER TABLE ADD COLUMN name TEXT`` (NULL values)."""
    if name in df.columns:
        if if_exists == "ignore":
            return df
        raise ColumnExists(f"duplicate column name: {name}")
    return df.withColumn(name, F.lit(None).cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """C11: ``ALTER TABLE DROP COLUMN``; an absent column is an error."""
    if name not in df.columns:
        raise ValueError(f"no such column: {name}")
    return df.drop(name)


def delete_where(df: DataFrame, conds: Mapping[str, Any] | Column) -> DataFrame:
    """``DELETE FROM t WHERE pred``; rows where pred is NULL stay (SQL)."""
    return df.where(~F.coalesce(condition(conds, df), F.lit(False)))


def load_from_src(target: DataFrame, src: DataFrame) -> DataFrame:
    """C14: append every ``_src`` row to the target, by column name."""
    return target.unionByName(align_to(src, target))


# ---------------------------------------------------------------- C12 column metadata

def meta_add(meta: DataFrame, field: str, description: str = "", *, obj_id: int, segment_id: int,
             project_id: int, is_mandatory: bool = False, is_key: bool = False,
             source_table: str | None = None, sap_structure: str | None = None) -> DataFrame:
    """Register a new target column in ``connection_fields`` with
    ``field_id = max(field_id) + 1`` (booleans are the strings "True"/"False")."""
    next_id = meta.agg((F.coalesce(F.max("field_id"), F.lit(0)) + 1).alias("field_id"))
    row = next_id.select(
        F.col("field_id").cast("long").alias("field_id"),
        F.lit(field).alias("fields"), F.lit(description).alias("description"),
        F.lit(str(bool(is_mandatory))).alias("isMandatory"), F.lit(str(bool(is_key))).alias("isKey"),
        F.lit(source_table).cast("string").alias("source_table"),
        F.lit(sap_structure).cast("string").alias("sap_structure"),
        F.lit(obj_id).cast("long").alias("obj_id_id"),
        F.lit(segment_id).cast("long").alias("segement_id_id"),
        F.lit(project_id).cast("long").alias("project_id_id"))
    return meta.unionByName(align_to(row, meta))


def meta_remove(meta: DataFrame, field: str, *, obj_id: int, segment_id: int, project_id: int) -> DataFrame:
    """Remove a column's metadata row for one (object, segment, project)."""
    hit = ((F.col("fields") == field) & (F.col("obj_id_id") == obj_id)
           & (F.col("segement_id_id") == segment_id) & (F.col("project_id_id") == project_id))
    return meta.where(~F.coalesce(hit, F.lit(False)))
