"""Small tables with nulls, empty and long texts, ties, repeated rows and columns
whose names operators use inside."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])
CLASHING = ("size", "digest", "n", "rid", "start", "block", "shard", "slot", "ids", "score", "kind", "part", "token", "cid", "keep_id", "body", "locator")

_WORDS = "the of and to in is for on with as by at from or an be this that which are was not have had they you were her all one we".split()


def prose(seed, n_words):
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + r.choice(["", "", "s", "ed", ","]) + str(r.randrange(60)) for _ in range(n_words))


def edge_rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "b"), (5, "", None, "b"),
        (6, "", "en", None), (7, "one", "en", None), (8, "ONE", "en", "a"), (9, "two words", "en", "a"), (10, " \t\n ", "en", "a"),
        (11, prose(2, 6000), "en", "a"), (12, prose(3, 300), "en", "c"), (13, base, "en", "c"), (13, base, "en", "c"),
        (14, "日本語 テキスト 😀 naïve ▁ \x00 é", "ja", "c"), (None, "no identifier here at all", "en", "c"), (None, None, None, None),
        (15, prose(4, 40), "en", ""), (16, prose(4, 40).upper(), "en", ""),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())]))
