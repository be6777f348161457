"""Snapshots, resumable runs, run log, lineage, reports, metadata."""

import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators import metadata, mutate
from tablewright.plans import lineage as lin
from tablewright.plans import requests as rq
from tablewright.plans import runs
from tablewright.plans.steps import ColumnLineage, Step
from tablewright.sources import backup, overwrite, read_csv, truncate, write_csv, write_json


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, name string, v double")


def _steps(fail_at=None):
    def s1(t, src):
        return mutate.set_if(t, "name", "a", "flag", "A", "other")

    def s2(t, src):
        if fail_at == 2:
            raise RuntimeError("boom")
        return t.withColumn("v", F.col("v") * 10)

    def s3(t, src):
        return mutate.add_column(t, "note")
    return [Step("flag", s1, statement="UPDATE"), Step("scale", s2, statement="UPDATE"),
            Step("note", s3, statement="ALTER-ADD")]


def test_resume_equals_uninterrupted(spark, base, scratch):
    full = runs.run_steps(spark, "r_full", _steps(), base, {}, run_dir=os.path.join(scratch, "full"))
    expect = sorted(tuple(r) for r in full.target.collect())
    d = os.path.join(scratch, "resumed")
    with pytest.raises(runs.StepFailed) as e:
        runs.run_steps(spark, "r1", _steps(fail_at=2), base, {}, run_dir=d, retries=0)
    assert e.value.index == 2
    res = runs.run_steps(spark, "r1", _steps(), base, {}, run_dir=d)
    assert res.resumed_from == 1
    assert sorted(tuple(r) for r in res.target.collect()) == expect
    assert res.summary.first()["rows"] == 3


def test_step_count_change_restarts(spark, base, scratch):
    d = os.path.join(scratch, "r")
    with pytest.raises(runs.StepFailed):
        runs.run_steps(spark, "r2", _steps(fail_at=2), base, {}, run_dir=d, retries=0)
    res = runs.run_steps(spark, "r2", _steps()[:2], base, {}, run_dir=d)
    assert res.resumed_from == 0


def test_retry_rule():
    assert not runs.retryable(mutate.ColumnExists("duplicate column name: x"))
    assert runs.retryable(RuntimeError("executor lost"))


def test_snapshot_and_apply_step(spark, base, scratch):
    p = os.path.join(scratch, "t_src")
    snap = runs.ensure_snapshot(base, p)
    again = runs.ensure_snapshot(base.limit(1), p)
    assert snap.count() == 3 and again.count() == 3
    move = Step("copy", lambda t, s: t.union(t.limit(1)), kind="data_movement")
    change = Step("upper", lambda t, s: t.withColumn("name", F.upper("name")))
    t2, s2 = runs.apply_step(move, base, snap, {})
    assert t2.count() == 4 and s2.count() == 4
    t3, s3 = runs.apply_step(change, t2, s2, {})
    assert {r.name for r in t3.collect()} == {"A", "B", "C"} and {r.name for r in s3.collect()} == {"a", "b", "c"}


def test_log_and_find_step(spark, scratch):
    p = os.path.join(scratch, "log")
    st = Step("bring MATNR", lambda t, s: t, statement="INSERT-SELECT", source_tables=("MARA",),
              description="bring material numbers from MARA")
    runs.log_step(spark, p, "s1", st, "t_24_ext")
    log = runs.log_step(spark, p, "s1", Step("other", lambda t, s: t, description="set plant"), "t_24_ext")
    assert sorted(r.transformation_id for r in log.collect()) == ["t_1", "t_2"]
    assert [r.seq for r in runs.find_step(log, "s1", "transformation 1").collect()] == [1]
    assert [r.seq for r in runs.find_step(log, "s1", "the previous one").collect()] == [2]
    assert [r.seq for r in runs.find_step(log, "s1", "the one from mara").collect()] == [1]


def test_lineage_report_sync(spark, base):
    steps = [Step("up", lambda t, s: t, lineage=(ColumnLineage("name", "src", "name", "string_manipulation"),
                                                 ColumnLineage("v", "src", "v"), ColumnLineage("const")))]
    lrows = lin.lineage(spark, steps, "t_1", "sess").collect()
    assert [(r.target_column, r.transformation_applied) for r in lrows] == [("name", True), ("v", False),
                                                                            ("const", False)]
    target = base.withColumn("name", F.upper("name")).withColumn("const", F.lit("X"))
    rep = lin.pre_post_report(target, {"src": base}, steps[0].lineage, "k").collect()
    assert tuple(rep[0]) == (1, "a", "A", 1.0, 1.0, None, "X")
    sc = lin.sync_check(base, base.limit(2)).first()
    assert (sc.row_counts_match, sc.schemas_match, sc.in_sync) == (False, True, False)


def test_selection_load(spark, base):
    src = spark.createDataFrame([(7, "x", "S"), (8, "y", "T")], "id int, nm string, seg string")
    t, s = runs.selection_load(base, src, {"k": "id", "name": "nm"}, {"seg": "S"})
    assert t.count() == 4 and s.count() == 1


def test_sql_log_classifiers(spark):
    df = spark.createDataFrame([
        ("INSERT INTO t_1 (A) SELECT MATNR FROM MARA", "t_1"),
        ("UPDATE t_1 SET A = 'X'", "t_1"),
        ("UPDATE [t_1] SET A = (SELECT B FROM MARA WHERE MARA.K = t_1.K)", "t_1"),
        ("ALTER TABLE t_1 ADD COLUMN Z TEXT", "t_1"),
        ("DELETE FROM other WHERE 1=1", "t_1"),
        ("UPDATE t_1 SET A = upper(A)", "t_1"),
    ], "sql string, tab string")
    out = rq.sql_sync_decision(rq.sql_target(rq.sql_kind(rq.sql_transform_type(df, "sql"), "sql"), "sql"),
                               "sql", "tab").collect()
    kinds = [r.statement_kind for r in out]
    assert kinds == ["INSERT-SELECT", "UPDATE", "UPDATE-FROM", "ALTER-ADD", "DELETE", "UPDATE"]
    assert [r.target_table for r in out][:4] == ["t_1", "t_1", "t_1", "t_1"]
    assert [r.sync for r in out] == [True, False, True, True, False, False]
    assert out[1].sync_reason.startswith("Data transformation")
    assert out[4].sync_reason == "Not a target table operation"
    assert out[5].transformation_type == "string_manipulation"


def test_classify_requests(spark):
    df = spark.createDataFrame([("join MARA and MAKT",), ("bring from mara and marc",), ("use previous segment",),
                                ("validate plant",), ("count materials",), ("bring field",)], "t string")
    got = [r.query_type for r in rq.classify_requests(df, "t").collect()]
    assert got == ["JOIN_OPERATION", "JOIN_OPERATION", "CROSS_SEGMENT", "VALIDATION_OPERATION",
                   "AGGREGATION_OPERATION", "SIMPLE_TRANSFORMATION"]


def test_metadata_resolution(spark):
    fields = spark.createDataFrame([
        (1, "MATNR", "Material", "True", "True", "MARA", None, 41, 577, 24),
        (2, "MTART", "Type", "True", "False", " ", None, 41, 577, 24),
        (3, "WERKS", "Plant", "False", "False", None, None, 41, 577, 24),
        (4, "OTHER", "x", "False", "False", "X", None, 1, 1, 1)],
        "field_id long, fields string, description string, isMandatory string, isKey string, source_table string,"
        " sap_structure string, obj_id_id long, segement_id_id long, project_id_id long")
    rules = spark.createDataFrame([(1, 1, "MATNR_OLD", "PRODUCT", 41, 577, 24), (1, 2, "MATNR", "PRODUCT", 41, 577, 24),
                                   (2, 1, "", "MTART", 41, 577, 24)],
                                  "field_id long, version_id long, source_field_name string, target_sap_field string,"
                                  " object_id_id long, segment_id_id long, project_id_id long")
    segs = spark.createDataFrame([(577, "Basic", "t_24_basic", 41, 24)],
                                 "segment_id long, segement_name string, table_name string, obj_id_id long,"
                                 " project_id_id long")
    m = metadata.resolve_mapping(fields, rules, segs, 41, 577, 24)
    got = {r.field_id: (r.source_field_name, r.target_sap_field) for r in m.collect()}
    assert got == {1: ("MATNR", "PRODUCT"), 2: ("", "MTART"), 3: (None, None)}
    c = {r.field_id: (r.source_table, r.source_field_name) for r in metadata.clean_mapping(m).collect()}
    assert c == {1: ("MARA", "MATNR"), 2: ("MARA", "MTART"), 3: ("MARA", None)}


def test_sources_round_trip(spark, base, scratch):
    p = write_csv(base, os.path.join(scratch, "csv"))
    back = read_csv(spark, p, base.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, base.collect()))
    j = write_json(base, os.path.join(scratch, "json"))
    assert spark.read.json(j).count() == 3
    b = backup(base, os.path.join(scratch, "bk"))
    assert b.count() == 3
    with pytest.raises(ValueError):
        overwrite(b, os.path.join(scratch, "bk"))
    assert overwrite(b, os.path.join(scratch, "bk2")).count() == 3
    assert truncate(base).count() == 0 and truncate(base).columns == base.columns


def test_cluster_conf_sizes_partitions():
    from tablewright.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert int(cluster_conf(10 ** 9)["spark.sql.shuffle.partitions"]) == 8000
    assert c["spark.sql.autoBroadcastJoinThreshold"] == str(64 * 1024 ** 2)


def test_bucketed_run_avoids_target_shuffle(spark, scratch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
        src = spark.range(0, 2000, 3).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("nv"))
        steps = [Step("up1", lambda t, s: mutate.update_from(t, s["src"], "k", {"v": "nv"})),
                 Step("up2", lambda t, s: mutate.update_from(t, s["src"], "k", {"v": F.col("nv") - 1}))]
        plain = runs.run_steps(spark, "plain", steps, target, {"src": src}, run_dir=os.path.join(scratch, "p"))
        bucketed = runs.run_steps(spark, "bk", steps, target, {"src": src}, run_dir=os.path.join(scratch, "b"),
                                  bucket_by="k", buckets=8)
        assert sorted(map(tuple, plain.target.collect())) == sorted(map(tuple, bucketed.target.collect()))
        plan = mutate.update_from(bucketed.target, src, "k", {"v": "nv"}, split_hot=False)._jdf.queryExecution() \
            .executedPlan().toString()
        scan_line = next(line for line in plan.splitlines() if "Bucketed: true" in line)
        assert "Exchange" not in scan_line
        assert plan.count("Exchange hashpartitioning") == 1      # only the source side moves
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_load_tables_and_read_json(spark, scratch):
    from tablewright.sources import load_tables, read_json, write_json
    from conftest import SF_SMALL
    t = load_tables(spark, SF_SMALL, ["nation", "region"], register=True)
    assert spark.sql("SELECT count(*) FROM nation").first()[0] == t["nation"].count() == 25
    p = write_json(t["region"], os.path.join(scratch, "region_json"))
    back = read_json(spark, p, t["region"].schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t["region"].collect()))


def test_writers_at_once_get_different_numbers(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from tablewright.plans import runs
    from tablewright.plans.steps import Step
    path = os.path.join(scratch, "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: runs.log_step(spark, path, "s", Step(f"step {i}", lambda t, s: t), "t"), range(8)))
    runs.log_step(spark, path, "other", Step("x", lambda t, s: t), "t")
    seqs = [r.seq for r in spark.read.parquet(path).where("session_id = 's'").collect()]
    assert sorted(seqs) == list(range(1, 9))
    assert [r.transformation_id for r in spark.read.parquet(path).where("session_id = 'other'").collect()] == ["t_1"]
