"""Running totals inside groups of which one may hold a third of all rows.

A window over the group alone would put the whole group into one task.  Here
each group is cut into buckets by a hash of the ordering key; the running total
inside (group, bucket) comes from a window, and the total of the buckets before
from a second, small window over one row per (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000


def bucket_count(n_rows: int) -> int:
    return 1 + n_rows // ROWS_PER_BUCKET


def running_start(df: DataFrame, group: str, key: list[str], value: Column, buckets: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group``
    that come before, in the order (hash bucket of ``key``, ``key``).  Rows with
    equal ``key`` are ordered arbitrarily among themselves.  Null groups form a
    group; null keys come first in their bucket."""
    b, local, total, before = (f"__{x}_{out}" for x in ("bucket", "local", "total", "before"))
    rows = df.withColumn(b, F.pmod(F.xxhash64(*key), F.lit(buckets))).withColumn(local, value.cast("long"))
    w = Window.partitionBy(group, b).orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (rows.groupBy(F.col(group).alias("__g"), F.col(b).alias("__b")).agg(F.sum(local).alias(total))
               .withColumn(before, F.sum(total).over(Window.partitionBy("__g").orderBy("__b")) - F.col(total))
               .select("__g", "__b", before))
    inside = rows.withColumn(out, F.sum(local).over(w) - F.col(local))
    joined = inside.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col(b) == F.col("__b")))
    return joined.withColumn(out, F.col(out) + F.col(before)).drop(b, local, before, "__g", "__b")
