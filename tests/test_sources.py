"""Publishing, recovery after a lost writer, files with malformed rows, layouts that
outlive a catalog, hot keys of unequal types."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from py4j.protocol import Py4JJavaError
from tablewright import sources
from tablewright.operators import mutate
from tablewright.plans import runs
from tablewright.plans.steps import Step


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _siblings(path):
    return sorted(n for n in os.listdir(os.path.dirname(path)) if n.startswith(os.path.basename(path)))


@pytest.fixture()
def table(spark, scratch):
    path = os.path.join(scratch, "t")
    sources.publish(spark.range(3), path)
    return path


def test_publish_replaces_and_leaves_nothing_beside(spark, table):
    assert _rows(sources.publish(spark.range(5, 7), table)) == [(5,), (6,)]
    assert _siblings(table) == ["t"]


def test_failed_write_keeps_the_table(spark, table):
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        sources.publish(bad, table)
    assert _rows(spark.read.parquet(table)) == [(0,), (1,), (2,)]
    assert _rows(sources.publish(spark.range(1), table)) == [(0,)] and _siblings(table) == ["t"]


def test_writer_lost_between_the_renames(spark, table):
    spark.range(9, 10).write.parquet(f"{table}.new-abc")
    os.rename(table, f"{table}.old-abc")
    assert sources.recover(spark, table) == "finished"
    assert _rows(spark.read.parquet(table)) == [(9,)] and _siblings(table) == ["t"]


def test_writer_lost_before_the_renames(spark, table):
    spark.range(9, 10).write.parquet(f"{table}.new-abc")
    assert sources.recover(spark, table) == "discarded"
    assert _rows(spark.read.parquet(table)) == [(0,), (1,), (2,)] and sources.recover(spark, table) == "clean"


def test_writer_lost_after_the_renames(spark, table):
    spark.range(9, 10).write.parquet(f"{table}.old-abc")
    assert sources.recover(spark, table) == "discarded" and _rows(spark.read.parquet(table)) == [(0,), (1,), (2,)]


def test_neighbours_with_like_names_stay(spark, table):
    sources.publish(spark.range(1), f"{table}2")
    sources.publish(spark.range(2), table)
    assert _siblings(table) == ["t", "t2"]


def test_backup_is_replaced_only_when_asked(spark, table):
    df = spark.read.parquet(table)
    sources.backup(df, f"{table}_b")
    with pytest.raises(PySparkException):
        sources.backup(df, f"{table}_b")
    assert _rows(sources.backup(spark.range(1), f"{table}_b", mode="overwrite")) == [(0,)]


def test_snapshot_of_a_write_that_broke_off_is_written_anew(spark, scratch):
    path = os.path.join(scratch, "src")
    spark.range(2).write.parquet(path)
    os.remove(os.path.join(path, "_SUCCESS"))
    assert _rows(runs.ensure_snapshot(spark.range(5, 6), path)) == [(5,)]
    assert _rows(runs.ensure_snapshot(spark.range(1), path)) == [(5,)]


TEXTS = [None, "", " ", "a,b", 'say "hi"', '"', "two\nlines", "cr\r\nlf", "back\\slash\\", "  outer  ", "NULL", "\ttab", "ünï"]


def test_csv_keeps_every_text(spark, scratch):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "k int, a string, b string")
    back = sources.read_csv(spark, sources.write_csv(df, os.path.join(scratch, "c")), df.schema)
    assert _rows(back) == _rows(df)


def test_json_keeps_every_text_and_null_columns(spark, scratch):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], "k int, a string, b string")
    path = sources.write_json(df, os.path.join(scratch, "j"))
    assert _rows(sources.read_json(spark, path, df.schema)) == _rows(df)
    assert sorted(spark.read.json(path).columns) == ["a", "b", "k"]


def test_malformed_rows_are_kept_whole(spark, scratch):
    path = os.path.join(scratch, "c.csv")
    with open(path, "w") as f:
        f.write('k,v\n1,2.5\nx,1\n2,1.5,more\n3\n4,\n5,"7"\n')
    rows = sources.read_csv(spark, path, "k int, v double", rescued="bad")
    good, bad = sources.split_rescued(rows, "bad")
    assert _rows(good) == [(1, 2.5), (4, None), (5, 7.0)]
    assert sorted(r.bad for r in bad.select("bad").collect()) == ["2,1.5,more", "3", "x,1"]
    assert rows.count() == 6 and bad.count() == 3
    assert sorted(r.k for r in good.select("k").collect()) == [1, 4, 5] and good.count() == 3
    with open(path, "w") as f:
        f.write("1,x\n2,1.0\n")
    rows = sources.read_csv(spark, path, "k int, v double", header=False, rescued="bad", multiline=False)
    assert [r.k for r in sources.split_rescued(rows, "bad")[0].select("k").collect()] == [2]  # v is read though not selected
    assert [r.bad for r in rows.select("bad").where("bad is not null").collect()] == ["1,x"]
    path = os.path.join(scratch, "j.json")
    with open(path, "w") as f:
        f.write('{"k": 1}\n{"k": \n{"k": "x"}\n{}\n')
    good, bad = sources.split_rescued(sources.read_json(spark, path, "k int", rescued="bad"), "bad")
    assert _rows(good) == [(1,), (None,)] and bad.select("bad").count() == 2


def test_rescued_needs_a_schema_without_that_name(spark, scratch):
    for schema in (None, "k int, bad string"):
        with pytest.raises(ValueError):
            sources.read_csv(spark, scratch, schema, rescued="bad")


def test_bucketed_run_resumes_bucketed_without_its_catalog(spark, scratch):
    """The catalog forgets the table between the two calls, as a new session's would."""
    target = spark.range(500).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"))
    src = spark.range(0, 500, 3).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("nv"))
    seen = []

    def steps(fail):
        def second(t, s):
            if fail:
                raise RuntimeError("lost")
            seen.append(t._jdf.queryExecution().executedPlan().toString())
            return mutate.update_from(t, s["src"], "k", {"v": F.col("nv") - 1}, split_hot=False)
        return [Step("first", lambda t, s: mutate.update_from(t, s["src"], "k", {"v": "nv"}, split_hot=False)), Step("second", second)]

    folder = os.path.join(scratch, "it's a run")
    with pytest.raises(runs.StepFailed):
        runs.run_steps(spark, "forgotten", steps(True), target, {"src": src}, run_dir=folder, retries=0, bucket_by="k", buckets=8)
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("tw_forgotten_")]:
        spark.sql(f"DROP TABLE {t}")
    out = runs.run_steps(spark, "forgotten", steps(False), target, {"src": src}, run_dir=folder, bucket_by="k", buckets=8)
    assert out.resumed_from == 1 and "Bucketed: " in seen[0]
    assert _rows(out.target) == sorted([(k, -2 if k % 3 == 0 else 0) for k in range(500)], key=repr)


@pytest.mark.parametrize("target_type,lookup_type", [("int", "long"), ("decimal(10,2)", "decimal(12,4)"), ("float", "double"), ("double", "double"),
                                                     ("decimal(9,0)", "decimal(9,0)"), ("string", "int")])
def test_keys_of_unequal_types_meet(spark, target_type, lookup_type):
    target = spark.range(6).select(F.col("id").cast(target_type).alias("k"), F.lit(None).cast("string").alias("v"))
    look = spark.range(0, 6, 2).select(F.col("id").cast(lookup_type).alias("lk"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    got = mutate.lookup(target, look, ("k", "lk"), "name", "v").orderBy("k").collect()
    assert [r.v for r in got] == ["n0", None, "n2", None, "n4", None]


def test_zeros_and_nan_meet_as_in_a_join(spark):
    target = spark.sql("SELECT * FROM VALUES (double('-0.0'), ''), (double('NaN'), ''), (CAST(NULL AS DOUBLE), '') AS t(k, v)")
    look = spark.sql("SELECT * FROM VALUES (double('0.0'), 'zero'), (double('NaN'), 'nan') AS t(lk, name)")
    assert {r.v for r in mutate.lookup(target, look, ("k", "lk"), "name", "v").collect()} == {"zero", "nan", None}
