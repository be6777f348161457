"""Column operators on a Structured Streaming DataFrame (stream-static join
included), written with exactly-once file output."""

import os

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.operators import conditional as cond, mutate
from tablewright.streaming import map_stream, read_table_stream, write_stream
from conftest import SF_SMALL


def test_stream_mapping(spark, scratch):
    orders = read_table_stream(spark, SF_SMALL, "orders")
    customer = spark.read.parquet(os.path.join(SF_SMALL, "customer.parquet"))

    def transform(df):
        df = df.select("o_orderkey", "o_custkey", "o_orderpriority", fn.date_text("o_orderdate").alias("d"))
        df = cond.map_in_lists(df, "o_orderpriority", [(["1-URGENT", "2-HIGH"], "HI")], "LO", "band")
        df = df.withColumn("quarter", fn.quarter_of("d"))
        return mutate.lookup(df, customer, ("o_custkey", "c_custkey"), "c_mktsegment", "segment")

    out = os.path.join(scratch, "out")
    q = write_stream(map_stream(orders, transform), out, checkpoint=os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == spark.read.parquet(os.path.join(SF_SMALL, "orders.parquet")).count()
    assert set(got.columns) >= {"band", "quarter", "segment"}
    assert got.where(F.col("segment").isNull()).count() == 0
