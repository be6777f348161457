"""Structured Streaming helpers for the column operators."""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablewright.session import checkpoint_root


def read_table_stream(spark: SparkSession, directory: str, name: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream the parquet data of table ``name``: a ``<name>.parquet`` folder,
    or a single ``<name>.parquet`` file in ``directory`` (the file source then
    watches the folder with a glob filter).  The schema is taken from the
    existing data, so there is no inference pass at start-up."""
    path = os.path.join(directory, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def map_stream(df: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a row-wise mapping (any composition of the Column operators and
    stream-static joins) to a streaming DataFrame.  Operators that need the
    whole table (diffs, key checks, aggregates without a watermark) are
    refused by Spark's streaming analyser, as they should be."""
    return transform(df)


def write_stream(df: DataFrame, path: str, checkpoint: str | None = None, trigger_once: bool = True,
                 fmt: str = "parquet") -> StreamingQuery:
    """Append the stream to a file table; the checkpoint (offsets + commit log)
    lives in the shared checkpoint folder so a restarted query resumes
    exactly once."""
    spark = df.sparkSession
    ckpt = checkpoint or os.path.join(checkpoint_root(spark), "streams", os.path.basename(path.rstrip("/")))
    w = df.writeStream.format(fmt).option("checkpointLocation", ckpt).option("path", path).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
