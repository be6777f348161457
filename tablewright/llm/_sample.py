"""Bounded samples of labelled texts for fitting on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, grades: list[int], per_grade: int, max_chars: int,
                    key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most ``per_grade`` texts of each grade, those whose identifiers have
    the smallest hashes, without texts of over ``max_chars`` characters: at most
    len(grades) * per_grade * max_chars characters reach the driver.

    The rows are chosen among the labels, so only this bounded set of
    identifiers is broadcast and no text is shuffled.  Labels that are null or
    belong to no document, and documents without text, are left out; of
    repeated labels of a document the largest counts."""
    known = labels.select(F.col(key).alias("__id"), grade.cast("int").alias("__grade")).where("__id IS NOT NULL AND __grade IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__grade").alias("__grade"))
    order = F.xxhash64("__id")
    chosen = reduce(DataFrame.unionByName, [known.where(F.col("__grade") == g).orderBy(order, "__id").limit(per_grade) for g in grades])
    rows = (docs.join(F.broadcast(chosen), F.col(key) == F.col("__id")).where(F.length(text) <= max_chars)
            .select("__id", F.col(text).alias("__text"), "__grade").collect())
    return [(r["__text"], r["__grade"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__text"]))]
