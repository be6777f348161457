"""The registered queries against DuckDB, where SQL can state them, and the pipeline."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm import queries
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.fixtures import labels
from tests.oracle_check import digest, duck


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) < set(names)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_duckdb(spark, name):
    df = entry.queries()[name](spark, SF_CHECK)
    con = duck(SF_CHECK).execute(queries.ORACLE[name])
    want = digest([c[0] for c in con.description], con.fetchall())
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    assert got[:3] == want[:3]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_duplicates", "mix", "encode"]
    kept = [docs]
    for f in list(stages.values())[:-1]:
        kept.append(corpus_pipeline.stage(f(spark, kept[-1], SF_SMALL), "test"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4]
    rejected = ids[0] - ids[1]
    assert all(quality.get(i) != 1 for i in rejected) and all(i in rejected for i, q in quality.items() if q == 0)
    assert ids[2] == {max(i for i in ids[1] if text[i] == t) for t in {text[i] for i in ids[1]}}
    last = stages["encode"](spark, kept[4], SF_SMALL)
    assert last.count() == kept[4].count() and {r.doc_id for r in last.collect()} == ids[4]


def test_pipeline_on_an_empty_table(spark, scratch):
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{SF_SMALL}/{name}.parquet").where("false")
        rows.write.parquet(os.path.join(scratch, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, scratch).count() == 0
    assert labels(spark, []).count() == 0


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "encode"])
def test_pipeline_sends_small_batches(spark, name):
    """Stages with Python take Arrow batches of a few MB, whatever Spark's limit of 10,000 rows makes of them."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "64m")
    try:
        stages = dict(corpus_pipeline.STAGES)
        stages[name](spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

        rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 1000).alias("text"))
        got = rows.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 5_000_000
    finally:
        spark.conf.set(limit, before)
