"""Dates of any width as Python's ``strptime`` reads them, and token counts as the
single checks give them."""

import itertools
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright.functions import checks
from tablewright.functions.dates import parse_text_ts


def _python(s, fmt):
    try:
        return datetime.strptime(s, fmt)
    except ValueError:
        return None


FORMATS = ["%Y%m%d", "%Y-%m-%d", "%d.%m.%Y", "%Y%m%d%H%M%S", "%d/%m/%Y %H:%M:%S.%f", "%H%M", "%Y  x%m"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_any_width_as_strptime(spark, fmt):
    tails = ["".join(x) for n in range(1, 5) for x in itertools.product("0123 9", repeat=n)]
    texts = ["2023" + x for x in tails] + ["2023-" + x[:2] + "-" + x[2:] for x in tails if len(x) > 2]
    texts += [f"{a}{sep}{b}{sep}2024" for sep in "./" for a in ("1", "01", " 1", "31", "0", "32") for b in ("1", "02", "13", "2")]
    texts += ["2023115", "202311512", "20231231235960", "2023123123595", "1/2/2024 3:4:5.5", "31/12/2024  23:59:59.123456", "1/2/2024 3:4:60.0",
              "235", "2359", "9", "", "x", "00000101", "0000101", "2023 X7", "2023\t x12", "2023  x0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ts for r in rows.select("t", parse_text_ts("t", fmt).cast("timestamp_ntz").alias("ts")).collect()}
    wrong = {t: (got[t], _python(t, fmt)) for t in texts if t is not None and got[t] != _python(t, fmt)}
    assert not wrong and got[None] is None


def test_seven_characters(spark):
    row = spark.range(1).select(fn.format_date(F.lit("2023115")).alias("a"), fn.convert_sap_date(F.lit("2023131"), "DD.MM.YYYY").alias("b"),
                                fn.format_date(F.lit("202300")).alias("c")).first()
    assert tuple(row) == ("2023-11-05", "31.01.2023", "202300")


def test_token_counts_equal_single_checks(spark):
    alphabet = ["1", "23", "4567890", "a@b.co", "@", ".", "-", "+", "e", "_", "nan", "Inf", "x", "\x0b", "\x1c", " ", "٣", "é", "a@b.c", "(0)"]
    import random
    rnd = random.Random(3)
    tokens = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(1500)]
    texts = ["", None, " ", "\n\r\t", "1"] + [rnd.choice(["", " ", "\n"]) + "".join(t + rnd.choice([" ", "\t", "\r\n", "  "]) for t in rnd.sample(tokens, 6)) + rnd.choice(tokens)
                                            for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    parts = docs.select("i", F.explode_outer(F.split("t", r"[ \t\n\r]+")).alias("k"))
    one = parts.groupBy("i").agg(F.count_if(checks.is_email("k")).alias("email"), F.count_if(checks.is_phone("k")).alias("phone"), F.count_if(checks.is_numeric("k")).alias("numeric"))
    exp = {r.i: (r.email, r.phone, r.numeric) for r in one.collect()}
    got = {r.i: (r.email, r.phone, r.numeric) for r in docs.select("i", *(fn.count_tokens("t", k).alias(k) for k in ("email", "phone", "numeric"))).collect()}
    assert got.pop(1) == (None, None, None) and exp.pop(1) == (0, 0, 0)
    assert got == exp and sum(x[0] for x in exp.values()) > 5 and sum(x[1] for x in exp.values()) > 20 and sum(x[2] for x in exp.values()) > 20
    # Nothing is tried again and again on long texts without a match.
    long = spark.createDataFrame([("a." * 50_000 + "@" + "1" * 50_000 + "_" * 1000,)], "t string")
    assert tuple(long.select(*(fn.count_tokens("t", k) for k in ("email", "phone", "numeric"))).first()) == (0, 0, 0)
    assert re.search(r"regexp_count", docs.select(fn.count_tokens("t", "phone"))._jdf.queryExecution().optimizedPlan().toString())
