"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
hangs neighbours below the smallest node around, until only stars are left.
Each round is written to the shared folder, so lineage stays short; nothing is
collected but a count and a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has a link to another one; the
    component is its smallest node."""
    a, b = F.col(left), F.col(right)
    edges = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        # Staged, so that the join below has two plain inputs and a hub's partition can be split.
        smallest = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-min", 2 * before[0])
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stage(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(least.select("u", F.col("m").alias("v"))).distinct(), "links", 2 * before[0])
        now = _checksum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
