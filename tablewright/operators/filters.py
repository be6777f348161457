"""Predicates, projection and filters."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from tablewright.operators._keys import all_of


def literal_like(value: Any, dtype: DataType | None) -> Column:
    """A literal in the type of the column it is compared with (S17); NULL, so no
    match, if it has no value of that type.  Spark folds this to a constant, so
    filters are still pushed down."""
    if isinstance(value, Column) or dtype is None:
        return value if isinstance(value, Column) else F.lit(value)
    if isinstance(dtype, IntegralType) and isinstance(value, float) and not value.is_integer():
        return F.lit(value)  # no integer equals it
    return F.lit(value).try_cast(dtype)


def condition(conds: Mapping[str, Any] | Column | None, df: DataFrame | None = None) -> Column:
    """B1: ``{field: value}`` -> ``field = value``; ``{field: [v, ...]}`` ->
    ``field IN (...)``; joined by AND.  Fields whose condition is ``None`` are
    skipped; an empty map is no filter.  A Column passes through.  Literals take
    the type of their column in ``df``."""
    if conds is None:
        return F.lit(True)
    if isinstance(conds, Column):
        return conds
    preds = []
    for field, value in conds.items():
        if value is None:
            continue
        dtype = df.schema[field].dataType if df is not None and field in df.columns else None
        if isinstance(value, (list, tuple, set, frozenset)):
            vals = list(value)
            if not vals:
                continue
            preds.append(F.col(field).isin([literal_like(v, dtype) for v in vals]))
        else:
            preds.append(F.col(field) == literal_like(value, dtype))
    return all_of(preds)


def where(df: DataFrame, conds: Mapping[str, Any] | Column | None) -> DataFrame:
    """B1: filter by a condition map (pushed down to the parquet scan)."""
    if conds is None or (isinstance(conds, Mapping) and not conds):
        return df
    return df.where(condition(conds, df))


def select(df: DataFrame, fields: Sequence[str | Column], conds=None) -> DataFrame:
    """A2: projection + filter (filter first so Catalyst prunes and pushes)."""
    return where(df, conds).select(*fields)


def match_columns(target_cols: Sequence[str], source_cols: Sequence[str]) -> dict[str, str | None]:
    """Target column -> source column: exact name; else the first source
    column equal (case-insensitive) or containing / contained in it; else None."""
    out: dict[str, str | None] = {}
    for t in target_cols:
        if t in source_cols:
            out[t] = t
            continue
        tl = t.lower()
        found = None
        for s in source_cols:
            sl = s.lower()
            if sl == tl or tl in sl or sl in tl:
                found = s
                break
        out[t] = found
    return out


def mapped_select(source: DataFrame, target_cols: Sequence[str],
                  mapping: Mapping[str, str] | None = None) -> DataFrame:
    """B3 applied: one column per target column, NULL where nothing matches."""
    mapping = dict(mapping or match_columns(target_cols, source.columns))
    return source.select(*[
        (F.col(mapping[t]) if mapping.get(t) else F.lit(None).cast("string")).alias(t) for t in target_cols])


_OPS = {
    "equals": lambda c, v: c == F.lit(v),
    "not_equals": lambda c, v: c != F.lit(v),
    "contains": lambda c, v: c.contains(str(v)),
    "starts_with": lambda c, v: c.startswith(str(v)),
    "ends_with": lambda c, v: c.endswith(str(v)),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
    "gt": lambda c, v: c > F.lit(v),
    "ge": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "le": lambda c, v: c <= F.lit(v),
}


def filter_rows(df: DataFrame, field: str, op: str, value: Any = None) -> DataFrame:
    """Keep rows where ``field <op> value``.  A comparison with NULL is not
    true, so NULL rows are dropped by every op except ``is_null`` (and
    ``not_equals`` drops them too, as SQL does)."""
    if op not in _OPS:
        raise ValueError(f"unknown condition type {op!r}; known: {sorted(_OPS)}")
    return df.where(_OPS[op](F.col(field), value))


def prefix_match(c: Column | str, prefix: str) -> Column:
    """SQLite ``LIKE 'p%'`` (case-insensitive; wildcards in ``prefix`` are
    literal here)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(c).startswith(prefix.lower())


def is_null(c: Column | str) -> Column:
    """B6."""
    return (F.col(c) if isinstance(c, str) else c).isNull()


def distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``SELECT DISTINCT cols`` (hash aggregate; duplicates are combined
    map-side before the shuffle, so a hot value costs one row per task)."""
    return (df.select(*cols) if cols else df).distinct()


# Names used by the reference's documented helpers.
filter_dataframe = filter_rows
