"""Conditional value mapping."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators._keys import (MATCH, dedupe_by_key, key_pairs, keyed_left_join,
                                         maybe_broadcast)

# Country codes of the region template (Europe 29, Asia 13).
EUROPE_CODES = ("DE", "FR", "IT", "ES", "NL", "BE", "AT", "CH", "SE", "NO", "DK", "FI", "IE",
                "PT", "GR", "PL", "CZ", "SK", "HU", "SI", "HR", "BG", "RO", "EE", "LV", "LT",
                "LU", "MT", "CY")
ASIA_CODES = ("CN", "JP", "KR", "IN", "TH", "SG", "MY", "ID", "PH", "VN", "TW", "HK", "MO")

def _v(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def case_map(df: DataFrame, branches: Sequence[tuple[Column, Any]], default: Any, dst: str) -> DataFrame:
    """``dst = CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... ELSE default END``;
    values may be literals or columns."""
    return df.withColumn(dst, case_expr(branches, default))


def case_expr(branches: Sequence[tuple[Column, Any]], default: Any) -> Column:
    expr = None
    for cond, value in branches:
        expr = F.when(cond, _v(value)) if expr is None else expr.when(cond, _v(value))
    return _v(default) if expr is None else expr.otherwise(_v(default))


def in_lists_expr(column: str | Column, branches: Sequence[tuple[Sequence[Any], Any]], default: Any) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return case_expr([(c.isin(list(vals)), res) for vals, res in branches], default)


def map_in_lists(df: DataFrame, column: str, branches: Sequence[tuple[Sequence[Any], Any]],
                 default: Any, dst: str) -> DataFrame:
    """``CASE WHEN col IN (A) THEN r1 WHEN col IN (B) THEN r2 ... ELSE default``.

    NULL falls to the default; the first branch listing a value wins.  One
    semantics for lists of any length: Spark tests a long list against a hash
    set, and a branch keeps the type of its result, a NULL result included."""
    return df.withColumn(dst, in_lists_expr(column, branches, default))


def _tier_source(tdf: DataFrame, spec: Sequence, default_key: str, name: str,
                 assume_unique: bool = False) -> tuple[DataFrame, str]:
    """Tier spec ``(df, value_col)`` (keyed by the target's key name) or
    ``(df, key_col, value_col)`` -> deduplicated ``(key, value)`` frame."""
    key_col, value_col = (default_key, spec[0]) if len(spec) == 1 else (spec[0], spec[1])
    src = tdf.select(F.col(key_col).alias(f"{name}_k"), F.col(value_col).alias(name))
    return dedupe_by_key(src, [f"{name}_k"], [name], assume_unique=assume_unique), f"{name}_k"


def tiered_lookup(target: DataFrame, key: str, tiers: Sequence[tuple], dst: str,
                  assume_unique: bool = False) -> DataFrame:
    """Value from the first tier whose table *has the key* (an existing NULL
    wins), else the next tier, else the last tier's value (NULL if absent).

    ``tiers`` items are ``(df, value_col)`` or ``(df, key_col, value_col)``.  Each
    tier is de-duplicated per key (smallest value) and left-joined with a match
    flag: N joins against key-unique frames, no correlated subquery."""
    out = target
    flags, vals = [], []
    for i, (tdf, *spec) in enumerate(tiers):
        src, k = _tier_source(tdf, spec, key, f"__tw_t{i}", assume_unique)
        out = keyed_left_join(out, src, [(key, k)], flag=f"__tw_m{i}")
        flags.append(F.col(f"__tw_m{i}").isNotNull())
        vals.append(F.col(f"__tw_t{i}"))
    expr = None
    for m, v in zip(flags[:-1], vals[:-1]):
        expr = F.when(m, v) if expr is None else expr.when(m, v)
    expr = vals[-1] if expr is None else expr.otherwise(vals[-1])
    keep = [c for c in target.columns if c != dst]
    return out.select(*keep, expr.alias(dst))


def nested_map(target: DataFrame, key: str, outer: Column, first: tuple, second: tuple,
               inner_default: Any, default: Any, dst: str) -> DataFrame:
    """D3: ``CASE WHEN outer THEN (CASE WHEN t1.f IN A THEN r1 WHEN t2.f IN B
    THEN r2 ELSE r3 END) ELSE default END`` with t1/t2 looked up by key.
    ``first``/``second`` are ``(df, key_col, value_col, values, result)``."""
    out = target
    for i, (tdf, kcol, vcol, _, _) in enumerate((first, second)):
        src, k = _tier_source(tdf, (kcol, vcol), key, f"__tw_n{i}")
        out = keyed_left_join(out, src, [(key, k)], flag=None)
    inner = (F.when(F.col("__tw_n0").isin(list(first[3])), _v(first[4]))
             .when(F.col("__tw_n1").isin(list(second[3])), _v(second[4]))
             .otherwise(_v(inner_default)))
    expr = F.when(F.coalesce(outer, F.lit(False)), inner).otherwise(_v(default))
    keep = [c for c in target.columns if c != dst]
    return out.select(*keep, expr.alias(dst))


def region_map(df: DataFrame, column: str, europe_value: Any, asia_value: Any, other_value: Any,
               dst: str, europe: Sequence[str] = EUROPE_CODES, asia: Sequence[str] = ASIA_CODES) -> DataFrame:
    """Region class of a country code (NULL or unknown -> other)."""
    return map_in_lists(df, column, [(europe, europe_value), (asia, asia_value)], other_value, dst)


def fill_null(target: DataFrame, key, column: str, other: DataFrame, other_col: str | None = None,
              default: Any = None, assume_unique: bool = False) -> DataFrame:
    """Keep a non-NULL value; else the value from ``other`` by key; else
    ``default``."""
    pairs = key_pairs(key)
    src = other.select(*[F.col(sk) for _, sk in pairs], F.col(other_col or column).alias("__tw_f"))
    src = dedupe_by_key(src, [sk for _, sk in pairs], ["__tw_f"], assume_unique=assume_unique)
    joined = keyed_left_join(target, src, pairs, flag=None)
    dtype = target.schema[column].dataType
    filled = F.coalesce(F.col(column), F.col("__tw_f").cast(dtype), _v(default).cast(dtype))
    return joined.select(*[filled.alias(c) if c == column else F.col(c) for c in target.columns])


def map_fields(target: DataFrame, source: DataFrame, fields: Mapping[str, str], key, **kw) -> DataFrame:
    """Copy ``{target_col: source_col}`` by key (Spark rows have no
    position, so the reference's positional mode is not offered)."""
    from tablewright.operators.mutate import update_from
    if key is None:
        raise ValueError("map_fields needs a key: rows have no position in Spark")
    return update_from(target, source, key, fields, **kw)


def decode(df: DataFrame, column: str, mapping: DataFrame | Mapping[Any, Any], dst: str,
           default: Any = None, key_col: str = "code", value_col: str = "text",
           broadcast_max_rows: int | None = 100_000) -> DataFrame:
    """Code -> text through a caller-given map (dict or DataFrame).  A dict
    is bounded by the spec and is broadcast; a DataFrame is broadcast only
    after its size is checked."""
    spark = df.sparkSession
    if isinstance(mapping, Mapping):
        ctype = df.schema[column].dataType
        mdf = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in mapping.items()],
                                    f"{key_col} {ctype.simpleString()}, {value_col} string")
        mdf = F.broadcast(mdf)
    else:
        mdf = dedupe_by_key(mapping.select(key_col, value_col), [key_col], [value_col])
        mdf = maybe_broadcast(mdf, broadcast_max_rows)
    joined = keyed_left_join(df, mdf.select(F.col(key_col), F.col(value_col).alias("__tw_d")),
                             [(column, key_col)], flag=MATCH)
    val = F.when(F.col(MATCH).isNotNull(), F.col("__tw_d")).otherwise(_v(default).cast("string"))
    keep = [c for c in df.columns if c != dst]
    return joined.select(*keep, val.alias(dst))


# Null coalescing helpers (SQLite COALESCE / IFNULL / IIF).
def coalesce(*cols: Any) -> Column:
    return F.coalesce(*[_v(c) if not isinstance(c, str) else F.col(c) for c in cols])


def ifnull(c: Any, alt: Any) -> Column:
    return coalesce(c, alt if not isinstance(alt, str) else F.lit(alt))


def iif(cond: Column, a: Any, b: Any) -> Column:
    return F.when(cond, _v(a)).otherwise(_v(b))


# Names used by the reference's documented helpers.
conditional_mapping = case_map
