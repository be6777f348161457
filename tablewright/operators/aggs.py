"""Aggregation (G1-G7).  Hash aggregates with map-side partial aggregation:
a hot group is combined inside every task before the shuffle."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.filters import where

_BASIC = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
# Other aggregate names passed through, limited to Spark built-ins.
_PASS_THROUGH = {"stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop",
                 "count_distinct", "approx_count_distinct", "median", "percentile_approx",
                 "first", "last", "any_value", "collect_set", "bool_and", "bool_or",
                 "count_if", "skewness", "kurtosis", "mode", "max_by", "min_by", "sum_distinct"}


def agg_column(function: str, field: str | None, alias: str | None = None) -> Column:
    """One aggregate: SUM/COUNT/AVG/MIN/MAX or a whitelisted Spark aggregate;
    default alias ``<function>_<field>`` (lower case)."""
    fn = function.upper()
    name = alias or f"{function.lower()}_{field if field not in (None, '*') else 'all'}"
    if fn in _BASIC:
        if fn == "COUNT" and field in (None, "*"):
            return F.count(F.lit(1)).alias(name)
        return _BASIC[fn](F.col(field)).alias(name)
    f = function.lower()
    if f not in _PASS_THROUGH or (field and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", field)):
        raise ValueError(f"unsupported aggregate {function}({field})")
    if f == "count_distinct":
        return F.count_distinct(F.col(field)).alias(name)
    if f == "sum_distinct":
        return F.sum_distinct(F.col(field)).alias(name)
    return F.expr(f"{f}({field})").alias(name)


def aggregate(df: DataFrame, group: Sequence[str], specs: Sequence[tuple], conds=None) -> DataFrame:
    """``SELECT group, f(x) AS alias FROM df WHERE .. GROUP BY group``;
    ``specs`` items are ``(function, field)`` or ``(function, field, alias)``.
    An empty ``group`` is a global aggregate (one row)."""
    cols = [agg_column(*s) for s in specs]
    src = where(df, conds)
    return src.groupBy(*group).agg(*cols) if group else src.agg(*cols)


def duplicate_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``GROUP BY cols HAVING COUNT(*) > 1`` with the count; NULL keys left out."""
    nn = df
    for c in cols:
        nn = nn.where(F.col(c).isNotNull())
    return nn.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def latest_per(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows carrying the largest ``version`` of their group, *all ties kept*
    (self join to ``MAX(version)``).  The max side has one row per group, so a
    hot group cannot blow up the join; AQE splits the hot partition of ``df``."""
    mx = df.groupBy(*keys).agg(F.max(version).alias("__tw_max"))
    mx = mx.select(*[F.col(k).alias(f"__tw_g{i}") for i, k in enumerate(keys)], "__tw_max")
    cond = [df[k] == F.col(f"__tw_g{i}") for i, k in enumerate(keys)] + [df[version] == F.col("__tw_max")]
    return df.join(mx, _and(cond), "left_semi")


def _and(cs):
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def summary(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``populated`` (columns non-NULL in at least
    one row) plus per-column non-NULL counts -- a single aggregation pass."""
    counts = [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("__tw_rows"), *counts)
    populated = sum((F.when(F.col(f"`{c}`") > 0, 1).otherwise(0) for c in df.columns), F.lit(0))
    return row.select(F.col("__tw_rows").alias("rows"), populated.alias("populated"),
                      F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("non_null"))


# The documented helper name.
aggregate_data = aggregate
