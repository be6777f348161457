"""Reading tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Words of a text: runs of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch.
ARROW_BYTES = 4 << 20
#: Rows of a file of a small table.
FILE_ROWS = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, so a lost executor costs only the tasks that run, and a table used
    several times is computed once.  With ``rows``, about how many narrow rows there are,
    few rows go to few files, however many shuffle partitions there are: for each file
    Hadoop's local file system starts processes of the executor."""
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of ``ARROW_BYTES``, not Spark's 64 MB:
    the executor and each worker hold whole batches, and keep their space when they are
    gone.  The setting stays, as a frame that a step returns runs later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
