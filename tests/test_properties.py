"""Property tests: batches of random strings checked against Python's own
semantics (the reference's functions are thin wrappers over them)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import functions as fn

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

NUMERIC_ALPHABET = "0123456789._eE+- infaINd\t"
TEXT_ALPHABET = "abcXYZ éÉü0129 '-_.,;\t"


def run(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.orderBy("i").select("i", *[e.alias(f"o{k}") for k, e in enumerate(exprs)])
            .collect()]


def py_float(s):
    if s is None:
        return None
    try:
        return float(s.strip()) if s.strip() else None
    except ValueError:
        return None


@SETTINGS
@given(st.lists(st.text(alphabet=NUMERIC_ALPHABET, max_size=8), min_size=50, max_size=80))
def test_numeric_parsing_matches_python_float(spark, values):
    got = run(spark, values, fn.is_numeric("v"), fn.py_float(F.col("v")))
    for v, (is_num, parsed) in zip(values, got):
        exp = py_float(v)
        assert is_num == (exp is not None), v
        if exp is None:
            assert parsed is None, v
        elif math.isnan(exp):
            assert parsed is not None and math.isnan(parsed), v
        else:
            assert parsed == exp, v


@SETTINGS
@given(st.lists(st.text(alphabet=TEXT_ALPHABET, max_size=12), min_size=30, max_size=60),
       st.integers(min_value=0, max_value=14))
def test_text_functions_match_python(spark, values, width):
    got = run(spark, values, fn.left_pad("v", width, "*"), fn.right_pad("v", width, "#"), fn.proper_case("v"),
              fn.reverse_string("v"), fn.split_string("v", " ", 1))
    for v, (lp, rp, title, rev, part) in zip(values, got):
        assert lp == v.rjust(width, "*") and rp == v.ljust(width, "#"), v
        assert title == v.title(), v
        assert rev == v[::-1], v
        parts = v.split(" ")
        assert part == (parts[1] if len(parts) > 1 else ""), v


def _py_format(s, fin, fout):
    from datetime import datetime
    if s is None:
        return ""
    try:
        return datetime.strptime(s, fin).strftime(fout)
    except ValueError:
        return s


def _py_add(s, n, fmt):
    from datetime import datetime, timedelta
    if s is None:
        return ""
    try:
        return (datetime.strptime(s, fmt) + timedelta(days=n)).strftime(fmt)
    except ValueError:
        return s


@SETTINGS
@given(st.lists(st.tuples(st.integers(1900, 2100), st.integers(0, 13), st.integers(0, 32)), min_size=40,
                max_size=60),
       st.integers(-400, 400))
def test_dates_match_python_strptime(spark, ymd, days):
    compact = [f"{y:04d}{m:02d}{d:02d}" for y, m, d in ymd]
    dashed = [f"{y}-{m}-{d}" for y, m, d in ymd]
    got = run(spark, compact, fn.format_date("v"), fn.format_date("v", "%Y%m%d", "%d %B %Y"),
              fn.date_add_days("v", days, "%Y%m%d"))
    for v, (iso, long_, added) in zip(compact, got):
        assert iso == _py_format(v, "%Y%m%d", "%Y-%m-%d"), v
        assert long_ == _py_format(v, "%Y%m%d", "%d %B %Y"), v
        assert added == _py_add(v, days, "%Y%m%d"), v
    got = run(spark, dashed, fn.date_add_days("v", days), fn.date_diff_days("v", F.lit("2000-01-01")))
    for v, (added, diff) in zip(dashed, got):
        assert added == _py_add(v, days, "%Y-%m-%d"), v
        try:
            from datetime import datetime
            exp = (datetime(2000, 1, 1) - datetime.strptime(v, "%Y-%m-%d")).days
        except ValueError:
            exp = 0
        assert diff == exp, v
