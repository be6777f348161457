"""SparkSession defaults used by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session needs for correct results (UTC wall-clock timestamps,
# ANSI on so bad casts surface unless an operator asks for try_* semantics) and
# for scale (AQE re-plans joins/partitions at runtime, skew splitting on).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tablewright", extra: dict | None = None) -> SparkSession:
    """Return (or create) the session with the library defaults applied.

    On a cluster ``master`` stays ``None`` so spark-submit decides; tests and
    the bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and step outputs.

    Read ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there).  Only in a local session where it is unset (tests) a scratch
    folder is created and recorded in the session so later calls agree; on a
    cluster an unset value is an error, never a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        root = tempfile.mkdtemp(prefix="tablewright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what several plans use
    is computed once, and a lost executor costs the tasks that run."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def cluster_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4) -> dict[str, str]:
    """Settings for a large run, from the input size: shuffle partitions so a
    partition holds ~256 MB before AQE coalesces them, scan splits of 256 MB,
    broadcast only under 64 MB (AQE measures the real size at runtime), skew
    splitting of partitions 5x the median and above 512 MB.  Pass the result
    as ``get_session(extra=...)`` or to spark-submit."""
    slots = executors * cores_per_executor
    partitions = max(slots * 2, input_bytes // (256 * 1024 * 1024))
    return {
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }
