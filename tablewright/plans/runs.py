"""Snapshots, step application and resumable multi-step runs.

Every step's result is written as a new parquet version under the shared
checkpoint folder (``spark.checkpoint.dir``), and the next step reads that
version: lineage is cut at each step, a lost executor costs at most the
current step, and a failed run resumes after its last finished step.  Paths
being read are never overwritten."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.aggs import summary
from tablewright.operators.filters import where
from tablewright.operators.mutate import ColumnExists, insert_select, load_from_src
from tablewright.plans.steps import Step
from tablewright.session import checkpoint_root
from tablewright.sources.tables import hadoop_path, publish

STATE_SCHEMA = ("run_id string, attempt string, step_index int, step_name string, status string, "
                "n_steps int, rows long, error string, output string, ts string")
# The run log's column names.
LOG_SCHEMA = ("session_id string, transformation_id string, seq int, timestamp string, original_query string, "
              "query_type string, source_tables array<string>, target_table string, "
              "fields_affected array<string>, rows long, is_multi_step boolean, steps_completed int")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ran to its end (Spark marks that)."""
    p, fs = hadoop_path(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# ---------------------------------------------------------------- R1 / R2

def ensure_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write the ``_src`` snapshot once; an existing one is kept.  It is
    published when complete, so what a write that broke off has left is no
    snapshot and is written anew."""
    spark = df.sparkSession
    return spark.read.parquet(path) if _finished(spark, path) else publish(df, path)


def apply_step(step: Step, target: DataFrame, src: DataFrame | None,
               sources: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """R2: apply a step to the target and, only when it is pure data movement,
    to the ``_src`` copy as well."""
    new_target = step.apply(target, sources)
    new_src = step.apply(src, sources) if (src is not None and step.kind == "data_movement") else src
    return new_target, new_src


# ---------------------------------------------------------------- R9 / R10 run log

def _claim(spark: SparkSession, log_path: str, session_id: str) -> tuple[int, str]:
    """The next sequence number of a session, taken by create-if-absent, and its file."""
    prev = _read_or_none(spark, log_path)
    last = None if prev is None else prev.where(F.col("session_id") == session_id).agg(F.max("seq")).first()[0]
    n = (last or 0) + 1
    folder = f"{log_path.rstrip('/')}-claims/{hashlib.sha256(session_id.encode()).hexdigest()[:32]}"
    while True:
        if _create_absent(spark, f"{folder}/{n}"):
            return n, f"{folder}/{n}"
        n += 1


def _create_absent(spark: SparkSession, path: str) -> bool:
    """Create a file; False if it exists.  Hadoop's own file systems decide that in
    one step; its wrapper of local files looks first, so there the system does."""
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            fs.create(p, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError as exc:
        if "FileAlreadyExists" not in exc.java_exception.getClass().getName():
            raise
        return False
    return True


def _publish(rows: DataFrame, staging: str, folder: str) -> None:
    """Write rows apart, then move the finished file into ``folder``: readers and
    other writers never meet a half-written file."""
    spark = rows.sparkSession
    rows.coalesce(1).write.parquet(staging)
    source, fs = hadoop_path(spark, staging)
    target, _ = hadoop_path(spark, folder)
    fs.mkdirs(target)
    for status in fs.listStatus(source):
        name = status.getPath().getName()
        if name.startswith("part-") and not fs.rename(status.getPath(), hadoop_path(spark, f"{folder}/{name}")[0]):
            raise OSError(f"{name} could not be moved to {folder}")
    fs.delete(source, True)


def log_step(spark: SparkSession, log_path: str, session_id: str, step: Step, target_table: str,
             rows: int | None = None, is_multi_step: bool = False, steps_completed: int = 0) -> DataFrame:
    """Append one history row with id ``t_<n>`` to the run log table (parquet,
    append).  The number is claimed by creating a file of that name beside the log,
    which succeeds for one writer only, so writers at the same time get different
    numbers; one that fails after its claim leaves a gap."""
    n, claim = _claim(spark, log_path, session_id)
    row = [(session_id, f"t_{n}", n, _now(), step.description or step.name, step.statement,
            list(step.source_tables), target_table, list(step.fields), rows, is_multi_step, steps_completed)]
    _publish(spark.createDataFrame(row, LOG_SCHEMA), f"{claim}-rows", log_path.rstrip("/"))
    return spark.read.parquet(log_path)


# How a request names an earlier step.
_NUMBERED = r"(?:transformation|step|query)\s*(\d+)"
_EARLIER = ("previous", "last", "prior", "earlier")


def find_step(log: DataFrame, session_id: str, reference: str) -> DataFrame:
    """R10: "transformation/step/query N" -> the N-th step; "previous / last /
    prior / earlier" -> the last one; otherwise steps whose request contains the
    text or whose source/target table is named in it."""
    ref = reference.lower()
    mine = log.where(F.col("session_id") == session_id)
    m = re.search(_NUMBERED, ref)
    if m:
        return mine.where(F.col("seq") == int(m.group(1)))
    if any(w in ref for w in _EARLIER):
        last = mine.agg(F.max("seq").alias("__m"))
        return mine.join(last, F.col("seq") == F.col("__m"), "left_semi")
    r = F.lit(ref)
    hit = (F.lower(F.col("original_query")).contains(ref)
           | F.exists("source_tables", lambda t: F.instr(r, F.lower(t)) > 0)
           | (F.instr(r, F.lower(F.col("target_table"))) > 0))
    return mine.where(hit)


# ---------------------------------------------------------------- R11 / R12 / R14

class StepFailed(RuntimeError):
    def __init__(self, index: int, name: str, cause: BaseException):
        super().__init__(f"step {index} ({name}) failed: {cause}")
        self.index, self.name, self.cause = index, name, cause


def retryable(exc: BaseException) -> bool:
    """Adding a column that already exists is not retryable; all else is."""
    return not isinstance(exc, ColumnExists) and "duplicate column" not in str(exc).lower()


@dataclass
class RunResult:
    target: DataFrame
    completed: int
    resumed_from: int
    attempt: str
    summary: DataFrame


def _state(spark: SparkSession, run_dir: str) -> DataFrame | None:
    return _read_or_none(spark, os.path.join(run_dir, "_state"))


def _write_state(spark: SparkSession, run_dir: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, STATE_SCHEMA).write.mode("append").parquet(os.path.join(run_dir, "_state"))


def _table_name(run_id: str, attempt: str, index: int) -> str:
    return re.sub(r"\W", "_", f"tw_{run_id}_{attempt}_step_{index:03d}").lower()


LAYOUT_SCHEMA = "columns string, bucket_by array<string>, buckets int"


def _write_step(df: DataFrame, path: str, table: str, bucket_by: Sequence[str], buckets: int) -> DataFrame:
    """Write one step's output.  With ``bucket_by`` the files are bucketed by
    the target key and registered as a catalog table, so the next keyed step
    reads the target already hash-partitioned by key: its join shuffles only
    the (smaller) source side.  The layout is recorded beside the files, for the
    catalog of a session may not outlive it."""
    spark = df.sparkSession
    if not bucket_by:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
     .option("path", path).saveAsTable(table))
    out = spark.table(table)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    spark.createDataFrame([(columns, list(bucket_by), buckets)], LAYOUT_SCHEMA).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}.layout")
    return out


def _read_step(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A step's output as it was laid out, also in a session that did not write it."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    record = _read_or_none(spark, f"{path}.layout")
    if record is None:
        return spark.read.parquet(path)
    layout = record.first()
    keys = ", ".join(f"`{k}`" for k in layout["bucket_by"])
    location = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({layout['columns']}) USING parquet "
              f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(table)


def run_steps(spark: SparkSession, run_id: str, steps: Sequence[Step], target: DataFrame,
              sources: Mapping[str, DataFrame], run_dir: str | None = None, retries: int = 1,
              bucket_by: str | Sequence[str] | None = None, buckets: int | None = None,
              keep_versions: bool = False) -> RunResult:
    """Run steps in order; each finished step's output is written to
    ``<run_dir>/<attempt>/step_<i>`` and recorded in ``<run_dir>/_state``.
    A failure stops the run (state kept, ``StepFailed`` raised); calling again
    resumes after the last finished step of the latest attempt, unless the
    number of steps changed, which starts a new attempt.  Retryable errors
    (R12) are retried ``retries`` times first.  A run that succeeds removes the
    versions before its last one and its step states; ``keep_versions`` keeps
    the versions.  ``bucket_by`` (the target key)
    writes every version bucketed by that key (``buckets``, default the
    shuffle partition count) so keyed steps do not re-shuffle the target."""
    keys = [bucket_by] if isinstance(bucket_by, str) else list(bucket_by or [])
    n_buckets = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    run_dir = run_dir or os.path.join(checkpoint_root(spark), "runs", run_id)
    state = _state(spark, run_dir)
    start, attempt, current = 0, None, target
    if state is not None:
        # latest state row; on equal time a "complete" row wins over a "done" one
        rank = F.when(F.col("status") == "complete", 2).when(F.col("status") == "failed", 1).otherwise(0)
        last = (state.where(F.col("run_id") == run_id)
                .orderBy(F.col("ts").desc(), F.col("step_index").desc(), rank.desc()).limit(1).collect())
        if last and last[0]["n_steps"] == len(steps) and last[0]["status"] != "complete":
            attempt = last[0]["attempt"]
            done = (state.where((F.col("attempt") == attempt) & (F.col("status") == "done"))
                    .agg(F.max("step_index").alias("m")).first()["m"])
            if done is not None:
                start = done
                current = _read_step(spark, os.path.join(run_dir, attempt, f"step_{done:03d}"),
                                     _table_name(run_id, attempt, done))
    attempt = attempt or uuid.uuid4().hex[:12]
    resumed_from = start
    for i in range(start, len(steps)):
        st = steps[i]
        out_path = os.path.join(run_dir, attempt, f"step_{i + 1:03d}")
        tries = 0
        while True:
            try:
                written = _write_step(st.apply(current, sources), out_path, _table_name(run_id, attempt, i + 1),
                                      keys, n_buckets)
                break
            except Exception as exc:  # noqa: BLE001
                tries += 1
                if tries <= retries and retryable(exc):
                    continue
                _write_state(spark, run_dir, [(run_id, attempt, i + 1, st.name, "failed", len(steps), None,
                                              str(exc), None, _now())])
                raise StepFailed(i + 1, st.name, exc) from exc
        current = written
        _write_state(spark, run_dir, [(run_id, attempt, i + 1, st.name, "done", len(steps), None, None,
                                      out_path, _now())])
    _write_state(spark, run_dir, [(run_id, attempt, len(steps), "", "complete", len(steps), None, None, None,
                                  _now())])
    if not keep_versions:
        for i in range(1, len(steps)):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(run_id, attempt, i)}")
            for left in (f"step_{i:03d}", f"step_{i:03d}.layout"):
                _delete(spark, os.path.join(run_dir, attempt, left))
    return RunResult(current, len(steps), resumed_from, attempt, summary(current))


# ---------------------------------------------------------------- R13

def selection_load(target: DataFrame, source: DataFrame, mapping: Mapping[str, Any], conds=None,
                   src: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Selection criteria: filtered, mapped source rows go into ``_src``
    (C1 on the snapshot), then the snapshot is loaded into the target (C14).
    Returns (new target, new _src)."""
    base_src = src if src is not None else target.limit(0)
    new_src = insert_select(base_src, where(source, conds), mapping)
    return load_from_src(target, new_src), new_src
