"""Scans, samples and sinks.

All reads are lazy parquet/CSV/JSON scans so Catalyst can push filters and
prune columns into the file reader; all writes are distributed (one file per
task, never a single-file collect on the driver).
"""

from __future__ import annotations

import os
import uuid
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def scan(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A1: lazy scan of ``<directory>/<name>.parquet`` (or a catalog table if
    ``directory`` is empty)."""
    if not directory:
        return spark.table(name)
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def load_tables(spark: SparkSession, directory: str,
                names: Iterable[str] = TABLE_NAMES, register: bool = False) -> dict[str, DataFrame]:
    out = {n: scan(spark, directory, n) for n in names}
    if register:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def sample(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """A3: the reference's ``LIMIT 5`` preview.  With ``order_by`` the rows are
    deterministic (Spark runs it as a TakeOrderedAndProject top-k: each task
    keeps n rows, so it never sorts the whole table)."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def hadoop_path(spark: SparkSession, path: str):
    """(Path, FileSystem) of a path, whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def publish(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by ``df``, or make it.

    The rows are written beside the table, under a name of this call's own, and
    take its place by renaming only when the write has ended.  Until then readers
    see the old table; a write that breaks off leaves it untouched.  Between the
    two renames of a replacement there is no table at ``path``; a writer lost
    there leaves both versions, and :func:`recover` (called by the next
    ``publish``) puts the new one in place.  One writer at a time; on an object
    store a rename copies."""
    spark = df.sparkSession
    recover(spark, path)
    path = path.rstrip("/")
    version = uuid.uuid4().hex
    new, old = f"{path}.new-{version}", f"{path}.old-{version}"
    df.write.parquet(new)
    target, fs = hadoop_path(spark, path)
    parked = hadoop_path(spark, old)[0]
    if fs.exists(target):
        _move(fs, target, parked)
    _move(fs, hadoop_path(spark, new)[0], target)
    fs.delete(parked, True)
    return spark.read.parquet(path)


def recover(spark: SparkSession, path: str) -> str:
    """End what a lost writer of ``path`` has begun: ``"finished"`` if the old
    table was parked already (its successor takes its place), ``"discarded"`` if
    only leftovers were removed, ``"clean"`` if there was nothing to do."""
    target, fs = hadoop_path(spark, path.rstrip("/"))
    parent, name = target.getParent(), target.getName()
    if not fs.exists(parent):
        return "clean"
    left = {s.getPath().getName() for s in fs.listStatus(parent)}
    mine = [n for n in left if n.startswith((f"{name}.new-", f"{name}.old-"))]
    done = "discarded" if mine else "clean"
    for n in mine:
        version = n.rsplit("-", 1)[1]
        if name not in left and n.startswith(f"{name}.old-") and f"{name}.new-{version}" in left:
            _move(fs, hadoop_path(spark, f"{parent}/{name}.new-{version}")[0], target)
            done = "finished"
    for n in mine:
        fs.delete(hadoop_path(spark, f"{parent}/{n}")[0], True)
    return done


def backup(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """``CREATE TABLE x_backup AS SELECT *`` -> parquet copy at a new path.
    Returns the re-read copy (lineage cut at the written files).  With
    ``mode="overwrite"`` an older backup stays until the new one is complete."""
    if mode == "overwrite":
        return publish(df, path)
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace a table by a DataFrame; readers see the old table until the
    new one is complete (:func:`publish`).

    A plan that still reads ``path`` is refused: it would find its input gone
    when it runs again -- write a new version path instead (see ``plans.runs``)."""
    inputs = {os.path.normpath(p.replace("file:", "")) for p in df.inputFiles()}
    target = os.path.normpath(path.replace("file:", ""))
    if any(p == target or p.startswith(target + os.sep) for p in inputs):
        raise ValueError(f"refusing to overwrite {path}: the DataFrame still reads from it")
    return publish(df, path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Temporary view so later steps may use ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


#: CSV as RFC 4180 states it: a quote inside a quoted field is doubled; an empty
#: field is NULL, a quoted empty one is the empty text.
_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_WRITE = {**_CSV, "nullValue": "", "emptyValue": '""'}
#: What the reader takes an empty field for, and NULL; a quoted empty field is "".
_READ = {**_CSV, "nullValue": "\0NULL", "emptyValue": ""}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A10: CSV report/export with a header, written by every task in parallel.
    Quotes, line breaks, outer blanks and NULL against the empty text survive a
    reading by :func:`read_csv`."""
    df.write.mode(mode).options(**_WRITE).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON-lines records sink.  NULL fields are written, so a row of NULLs
    keeps its columns."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def _with_rescued(schema: StructType | str | None, rescued: str) -> StructType:
    if schema is None:
        raise ValueError("rescued needs a schema: only against one is a row malformed")
    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    if rescued in [f.name for f in fields]:
        raise ValueError(f"{rescued} is a column of the schema")
    return StructType([*fields, StructField(rescued, StringType())])


def _tied(df: DataFrame, rescued: str) -> DataFrame:
    """Spark parses the columns a plan reads, so a row that is malformed in another
    one would pass, and it refuses plans that read the rescued column alone.  An
    empty text that depends on every column is put behind the rescued line."""
    *others, last = [f"`{c}`" for c in df.columns]
    tie = F.repeat(F.concat(*[F.col(c).isNull().cast("string") for c in others]), F.lit(0))
    return df.withColumn(rescued, F.concat(F.col(last), tie))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, rescued: str | None = None, multiline: bool = True) -> DataFrame:
    """CSV source.  A schema should be given (no inference pass over the data).

    ``rescued`` names a column for the whole line of a malformed row (a field that
    does not parse as its type, or a wrong number of fields); it is NULL for the
    others, and no row is lost (see :func:`split_rescued`).  ``multiline`` lets a
    quoted field hold line breaks, for which a file is read by one task; set it to
    False for large files without such fields, which are then split."""
    reader = spark.read.options(**_READ).option("header", header).option("multiLine", multiline)
    if rescued is not None:
        reader = (reader.schema(_with_rescued(schema, rescued)).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", rescued).option("columnPruning", False))
        return _tied(reader.csv(path), rescued)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None,
              rescued: str | None = None) -> DataFrame:
    """JSON-lines source; ``rescued`` as in :func:`read_csv`."""
    reader = spark.read
    if rescued is not None:
        reader = (reader.schema(_with_rescued(schema, rescued)).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", rescued))
        return _tied(reader.json(path), rescued)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def split_rescued(df: DataFrame, rescued: str) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, without the rescued column; malformed rows with it)."""
    bad = F.col(rescued).isNotNull()
    return df.where(~bad).drop(rescued), df.where(bad)


def truncate(df: DataFrame) -> DataFrame:
    """``DELETE FROM t`` -- no rows, same schema (no job is run)."""
    return df.where(F.lit(False))
