"""Key handling shared by the operators: key pairs, de-duplication, match flags
and size-checked broadcast."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, LongType, StringType, TimestampType

MATCH = "__tw_matched"


def key_pairs(key) -> list[tuple[str, str]]:
    """``"k"`` / ``("tk", "sk")`` / ``[("tk", "sk"), ...]`` / ``{"tk": "sk"}`` ->
    list of (target column, source column)."""
    if isinstance(key, str):
        return [(key, key)]
    if isinstance(key, dict):
        return list(key.items())
    if isinstance(key, tuple) and len(key) == 2 and all(isinstance(k, str) for k in key):
        return [key]
    out = []
    for k in key:
        out.append((k, k) if isinstance(k, str) else tuple(k))
    return out


def dedupe_by_key(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                  order: str | Column | None = None, pick: str = "min",
                  assume_unique: bool = False) -> DataFrame:
    """One row per key, never an arbitrary one.

    One rule for any number of values: NULLs come after all values, column by
    column, and the smallest (``pick="min"``) or largest value (tuple) is kept.
    With ``order`` the row with the smallest/largest order value is kept; a NULL
    order comes after all others, ties go by the values.  This is an aggregate
    with map-side partial aggregation, so a key holding a third of all rows is
    combined inside each task before the shuffle.  NULL keys are dropped: they
    never match an equi-join.  ``assume_unique`` skips the aggregate when the
    caller guarantees unique keys (a duplicate would then multiply target rows).
    """
    keys, values = list(keys), list(values)
    df = df.where(all_of([F.col(k).isNotNull() for k in keys]))
    if assume_unique:
        # The caller guarantees one row per key (a primary key): no aggregate.
        return df.select(*keys, *values)
    if not values:
        return df.select(*keys).distinct()
    best = F.min if pick == "min" else F.max

    def last_if_null(c: Column) -> list[Column]:
        return [c.isNull() if pick == "min" else c.isNotNull(), c]

    if order is None and len(values) == 1:
        # min/max skip NULLs unless a key has only NULLs: the same rule, and
        # fixed-width values keep a hash aggregate.
        return df.groupBy(*keys).agg(best(values[0]).alias(values[0]))
    ranked = [] if order is None else last_if_null(order if isinstance(order, Column) else F.col(order))
    for v in values:
        ranked += last_if_null(F.col(v))
    packed = F.struct(*[c.alias(f"__tw_r{i}") for i, c in enumerate(ranked)])
    first = 1 if order is None else 3
    out = df.groupBy(*keys).agg(best(packed).alias("__tw_v"))
    return out.select(*keys, *[F.col("__tw_v")[f"__tw_r{first + 2 * i}"].alias(v) for i, v in enumerate(values)])


def _all(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def all_of(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    return _all(preds) if preds else F.lit(True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Size check before a broadcast: reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows;
    otherwise leave the strategy to Spark (AQE turns a shuffle join into a
    broadcast at runtime when the real size is under its threshold, and splits
    skewed partitions otherwise)."""
    if max_rows is not None and fits(df, max_rows):
        return F.broadcast(df)
    return df


# Types whose equal values have equal hashes (-0.0 and NaN included).
_HASHABLE = (StringType, BooleanType, IntegralType, DateType, TimestampType, DecimalType, FloatType, DoubleType)


def _hash_type(a: DataType, b: DataType) -> DataType | None:
    """A type in which keys of types ``a`` and ``b`` are equal just where a join
    takes them as equal; None if there is none here."""
    if a == b:
        return a if isinstance(a, _HASHABLE) else None
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    if isinstance(a, (FloatType, DoubleType)) and isinstance(b, (FloatType, DoubleType)):
        return DoubleType()
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        return DecimalType(digits, scale) if digits <= 38 else None
    return None


def keyed_left_join(target: DataFrame, lookup: DataFrame, pairs: list[tuple[str, str]],
                    flag: str | None = MATCH, split_hot: bool = True) -> DataFrame:
    """Left join ``target`` to a lookup that is unique on its key columns.

    The lookup's key columns are renamed away so the target's key columns
    survive untouched; ``flag`` is TRUE on matched rows (distinguishes "matched
    with a NULL value" from "no match", SURVEY S2).

    A lookup that was reduced to one row per key is already partitioned by the
    key, and Spark splits a hot partition of a join only where both sides come
    straight from a shuffle.  ``split_hot`` therefore (for keys of like types, see
    ``_hash_type``) joins on a hash of the key
    besides the key: the (reduced) lookup is shuffled once more, and a key with
    a third of the target's rows spreads over several tasks.  A target that is
    bucketed by the key keeps its layout only without it."""
    renamed = lookup
    conds = []
    types = [_hash_type(target.schema[tk].dataType, lookup.schema[sk].dataType) for tk, sk in pairs]
    for i, (tk, sk) in enumerate(pairs):
        alias = f"__tw_k{i}"
        renamed = renamed.withColumnRenamed(sk, alias)
        conds.append(target[tk] == renamed[alias])
    if flag:
        renamed = renamed.withColumn(flag, F.lit(True))
    if split_hot and pairs and None not in types:
        renamed = renamed.withColumn("__tw_h", F.xxhash64(*[F.col(f"__tw_k{i}").cast(t) for i, t in enumerate(types)]))
        conds.append(F.xxhash64(*[target[tk].cast(t) for (tk, _), t in zip(pairs, types)]) == renamed["__tw_h"])
    joined = target.join(renamed, all_of(conds), "left")
    return joined.drop("__tw_h", *[f"__tw_k{i}" for i in range(len(pairs))])
