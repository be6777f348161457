"""Operator 8: exact deduplication with keyed streaming state.

Rows stream through a stateful aggregation keyed by a digest of the text.  The
state store is RocksDB (on disk) and never expires; per digest it retains the
identifier of the row that stays (the largest), the locator of its content (a
hash of the file that holds it) and the number of rows.  Map-side combining
comes before the state shuffle, so a text that holds a third of all rows sends
one row per task.

A digest seen more than once is a *hit*.  Every hit is checked on its full
bytes against the content of the row that stays, fetched by digest, identifier
and locator; digests whose bytes differ are grouped again by the bytes.

Native: DataFrame operations only; ``foreachBatch`` runs on the driver and only
writes the changed keys of a batch as Parquet.

Defined results: null text equals the empty text; of repeated rows with the same
identifier one stays (``kept`` holds for each of them, as they cannot be told
apart); a null identifier loses against any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._io import scratch, stage, text_or_empty

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: While a stream runs.  Without the second, each state partition reserves 4 MB of disk however little it holds.
_SETTINGS = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _locator() -> Column:
    return F.xxhash64(F.input_file_name())


def digest_stream(stream: DataFrame, digest: Callable[[Column], Column] = sha256, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The narrow form of a stream of records: digest, doc_id, locator."""
    return stream.select(digest(text_or_empty(text)).alias("digest"), F.col(key).alias("doc_id"),
                         _locator().alias("locator"))


def run_state(records: DataFrame, name: str = "dedup") -> DataFrame:
    """Run the keyed state over all records that are there now; return one row
    per digest: digest, keep_id, keep_locator, group_size.  A batch that is
    replayed after a failure writes the same folder again."""
    spark = records.sparkSession
    root = scratch(spark, name)
    changed = records.groupBy("digest").agg(F.max("doc_id").alias("keep_id"),
                                            F.max_by("locator", "doc_id").alias("keep_locator"),
                                            F.count(F.lit(1)).alias("group_size"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (changed.writeStream.outputMode("update").foreachBatch(save)
                 .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    schema = StructType([*changed.schema.fields, StructField("batch", LongType())])
    try:
        states = spark.read.schema(schema).option("basePath", f"{root}/state").parquet(f"{root}/state")
    except Exception as exc:  # no batch ran: there was no input file
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], changed.schema)
    return states.groupBy("digest").agg(F.max("keep_id").alias("keep_id"),
                                        F.max_by("keep_locator", "batch").alias("keep_locator"),
                                        F.max("group_size").alias("group_size"))


def deduplicate(docs: DataFrame, stream: DataFrame | None = None, digest: Callable[[Column], Column] = sha256,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    ``stream`` is the streaming read of the same files; without it the digests
    of ``docs`` are written to the shared folder and streamed from there."""
    spark = docs.sparkSession
    body = text_or_empty(text)
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("body"), digest(body).alias("digest"),
                       _locator().alias("locator"))
    if stream is None:
        narrow = stage(rows.select("digest", "doc_id", "locator"), "dedup-digests")
        path = narrow.inputFiles()
        source = path[0].rpartition("/")[0] if path else scratch(spark, "dedup-empty")
        if not path:
            narrow.write.parquet(source)
        records = spark.readStream.schema(narrow.schema).parquet(source)
    else:
        records = digest_stream(stream, digest, key, text)
    state = stage(run_state(records), "dedup-state")
    hit = F.col("group_size") > 1
    joined = stage(rows.join(state, "digest").select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.coalesce("keep_locator", "locator"))).alias("keeper"),
        F.when(hit, F.col("body")).alias("body")), "dedup-joined")
    hits = joined.where(hit)
    # One content per digest; max() of equal bytes, so repeated identifiers in a file do no harm.
    # Staged, so that the join has two plain inputs and the partition of a hot digest can be split.
    content = stage(hits.where("keeper").groupBy("digest").agg(F.max("body").alias("keep_body")), "dedup-content")
    clash = stage(hits.join(content, "digest", "left").where(~F.col("body").eqNullSafe(F.col("keep_body"))).select("digest").distinct(),
                  "dedup-clash")
    out = joined.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    if clash.isEmpty():
        return out
    # Different bytes under one digest: group those rows by the bytes themselves.
    apart = hits.join(clash, "digest", "left_semi").select("doc_id", "digest", "body")
    groups = apart.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = apart.join(groups, ["digest", "body"]).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return out.join(clash, "digest", "left_anti").unionByName(again)


def survivors(docs: DataFrame, stream: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with equal
    texts and equal identifiers one stays."""
    marks = deduplicate(docs, stream, key=key, text=text).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumn("__of", sha256(text_or_empty(text)))
    same = (F.col("__of") == F.col("__digest")) & F.col(key).eqNullSafe(F.col("__id"))
    return rows.join(marks, same, "left_semi").dropDuplicates([key, "__of"]).drop("__of")
