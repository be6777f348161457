"""Operator 9: sharding by weighted rendezvous hashing.

Every (record key, shard) pair gets a pseudorandom number u in (0, 1) from a
hash; the record goes to the shard with the smallest -ln(u) / weight.  The
choice needs nothing but the key and the shard list, so each row is placed in
its own task without a shuffle, and a further shard takes rows only into itself.

Law: ``key``.  Only the record key and the shards decide; rows with equal texts
and different keys are placed independently, rows with equal keys together.

Defined results: a null key is the key "" ; null texts count as empty (size 1,
CRC of no bytes: 0); repeated rows go to the same shard and get slots of their
own; an empty table gives no rows; other columns are ignored, and are kept by
:func:`write_shards`, which replaces columns of the names it adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import text_or_empty
from ._prefix import bucket_count, running_start

_MANTISSA = float(1 << 53)


def unit_hash(key: Column, shard: int, salt: str) -> Column:
    """A double strictly between 0 and 1 from the key, the shard and a salt."""
    h = F.xxhash64(F.concat_ws("\u0001", F.lit(salt), F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(_MANTISSA)


def shard_of(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (0 .. len(weights) - 1) of a record key.  Shards of weight 0
    get nothing; equal scores go to the lower shard."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative and one of them positive")
    scores = [F.struct((-F.log(unit_hash(key, i, salt)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
              for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, n_shards: int = 8, weights: Sequence[float] | None = None, key: str = "doc_id",
                  text: str = "text", salt: str = "shard") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 1), text_crc32,
    shard, grown_shard (with one more shard, of the mean weight) and slot
    (gapless from 0 in its shard, in an order that only the keys decide)."""
    weights = list(weights or [1.0] * n_shards)
    body = text_or_empty(text)
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = rows.withColumns({
        "shard": shard_of(F.col("doc_id"), weights, salt),
        "grown_shard": shard_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)], salt)})
    return running_start(placed, "shard", ["doc_id", "text_crc32", "size"], F.lit(1), bucket_count(docs.count()), "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, weights: Sequence[float] | None = None,
                 key: str = "doc_id", salt: str = "shard") -> None:
    """Write the whole rows of ``docs`` into one folder per shard."""
    shard = shard_of(F.col(key), list(weights or [1.0] * n_shards), salt)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
