"""A training-data pipeline over ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.  Python workers outlive a stage, so stages with
Python take small Arrow batches, and what a worker remembers goes with its task or stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import group_join, mixing, ordinal_quality, piece_bpe, stream_dedup
from tablewright.llm._io import small_batches, stage, table
from tablewright.llm.queries import MODEL, rating


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with even odds or more of being better than junk stay."""
    small_batches(spark)
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"), rating(), grades=3)
    return ordinal_quality.accept(docs, model, select_grade=1, threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return stream_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles
    the one with the smallest doc_id stays."""
    small_batches(spark)
    return group_join.representatives(docs, words=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass."""
    mixed = mixing.mixed_documents(docs, weights=(5, 2, 1), max_repeats=3.0)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, as counts and digests, and the decoded text's digest."""
    small_batches(spark)
    return piece_bpe.digests(docs, public_tokenizers.path(MODEL))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
