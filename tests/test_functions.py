"""Scalar functions (E1-E23, P1-P13) against Python's own semantics on the
edge rows of FIXTURES.md: NULL, empty, bad format, negative index, over-length
pad, zero divisor, numbers as text, bad JSON, JSON scalar, bad dates."""

import json
import math
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright import functions as fn

TEXTS = [None, "", "abc", "O'neil 3rd a-b", "hello world foo", "  padded  ", "a,b,,c", "Ünïcode straße",
         "MiXeD Case", "x"]


def _one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def _run(spark, values, expr, dtype="string"):
    df = _one_col(spark, values, dtype)
    return [r[0] for r in df.orderBy("i").select(expr.alias("o")).collect()]


# ----------------------------------------------------------------- python references

def py_title(s):
    return "" if s is None else s.title()


def py_float_ok(s):
    if s is None:
        return False
    s = str(s).strip()
    if not s:
        return False
    try:
        float(s)
        return True
    except ValueError:
        return False


def test_proper_case(spark):
    assert _run(spark, TEXTS, fn.proper_case(F.col("v"))) == [py_title(t) for t in TEXTS]


def test_reverse(spark):
    assert _run(spark, TEXTS, fn.reverse_string("v")) == ["" if t is None else t[::-1] for t in TEXTS]


@pytest.mark.parametrize("n,ch", [(10, "*"), (3, "0"), (0, ""), (12, "xy")])
def test_pads_never_truncate(spark, n, ch):
    exp_l = [("" if t is None else t).rjust(n, ch[0] if ch else " ") for t in TEXTS]
    exp_r = [("" if t is None else t).ljust(n, ch[0] if ch else " ") for t in TEXTS]
    assert _run(spark, TEXTS, fn.left_pad("v", n, ch)) == exp_l
    assert _run(spark, TEXTS, fn.right_pad("v", n, ch)) == exp_r


@pytest.mark.parametrize("delim,idx", [(",", 0), (",", 2), (",", 5), (",", -1), (" ", 1), ("", 1), (None, 0),
                                       (",", None)])
def test_split_string(spark, delim, idx):
    def ref(s):
        if s is None:
            return ""
        d = "," if delim is None else delim
        if d == "":
            return s
        parts = s.split(d)
        if idx is None:
            return d.join(parts)
        return parts[idx] if 0 <= idx < len(parts) else ""
    assert _run(spark, TEXTS, fn.split_string("v", delim, idx)) == [ref(t) for t in TEXTS]


@pytest.mark.parametrize("pat,rep,flags", [(r"(\w+) (\w+)", r"\2_\1", None), ("o", "0", None), ("A", "@", "i"),
                                           ("", "z", None), ("[", "z", None), (r"\s+", "", None),
                                           (r"(?P<w>l+)", r"<\g<w>>", None), ("b", None, None), ("$", "$", None)])
def test_regexp_replace(spark, pat, rep, flags):
    def ref(s):
        if s is None:
            return ""
        if not pat:
            return s
        try:
            f = re.IGNORECASE if flags and "i" in flags else 0
            return re.sub(pat, rep or "", s, flags=f)
        except re.error:
            return s
    assert _run(spark, TEXTS, fn.regexp_replace("v", pat, rep, flags)) == [ref(t) for t in TEXTS]


@pytest.mark.parametrize("pat,group", [(r"(\w+)$", 1), (r"^(x+)", 1), (r"l+", 0), (r"(a)(b)", 3), ("[", 0)])
def test_regexp_extract_and_match(spark, pat, group):
    def ref(s):
        if s is None:
            return None
        try:
            m = re.search(pat, s)
            return m.group(group) if m else None
        except (re.error, IndexError):
            return None

    def ref_match(s):
        if s is None:
            return False
        try:
            return bool(re.search(pat, s))
        except re.error:
            return False
    assert _run(spark, TEXTS, fn.regexp_extract(pat, "v", group)) == [ref(t) for t in TEXTS]
    assert _run(spark, TEXTS, fn.regexp_match(pat, "v")) == [ref_match(t) for t in TEXTS]


NUMS = [None, "", "12", " 12 ", "1e5", "1_000", "1d", "nan", "inf", "-Infinity", "abc", "0", "1.", ".5", "+3",
        "1__0", "0x10", "1f"]


def test_is_numeric(spark):
    assert _run(spark, NUMS, fn.is_numeric("v")) == [py_float_ok(x) for x in NUMS]


def test_safe_divide_percentage_power(spark):
    def fl(x):
        return float(str(x).strip()) if py_float_ok(x) else None

    def ref_div(a):
        if a is not None and fl(a) is None:
            return 0.0
        num = 0.0 if a is None else fl(a)
        return num / 4.0

    out = _run(spark, NUMS, fn.safe_divide("v", 4))
    for got, x in zip(out, NUMS):
        exp = ref_div(x)
        assert (math.isnan(got) and math.isnan(exp)) or got == exp, (x, got, exp)
    zero = _run(spark, ["5", None], fn.safe_divide("v", 0, -1))
    assert zero == [-1.0, -1.0]
    pct = _run(spark, ["1", "3", None, "x"], fn.percentage("v", 8, 2))
    assert pct == [12.5, 37.5, 0.0, 0.0]
    pw = _run(spark, ["-1", "2", None, "0"], fn.power_of("v", F.lit(-0.5)))
    # math.pow(-1, -0.5) and math.pow(0, -0.5) raise -> 0.0; NULL base -> 0.0 ** -0.5 raises -> 0.0
    assert pw[0] == 0.0 and abs(pw[1] - 2 ** -0.5) < 1e-12 and pw[2] == 0.0 and pw[3] == 0.0


DATES = [None, "", "20230115", "20230230", "2023011", "20231301", "20240229", "abc"]


def test_format_date_and_iso(spark):
    def ref(s, fin="%Y%m%d", fout="%Y-%m-%d"):
        if s is None:
            return ""
        try:
            return datetime.strptime(s, fin).strftime(fout)
        except ValueError:
            return s
    got = _run(spark, DATES, fn.format_date("v"))
    exp = [ref(d) for d in DATES]
    assert got == exp
    assert _run(spark, DATES, fn.format_date("v", "%Y%m%d", "%B %d, %Y"))[2] == "January 15, 2023"
    assert _run(spark, ["20230115", None, "2023"], fn.yyyymmdd_to_iso("v")) == ["2023-01-15", None, "2023--"]


def test_date_add_and_diff(spark):
    vals = ["2023-01-31", "2023-2-3", "bad", None, "2024-02-28"]
    got = _run(spark, vals, fn.date_add_days("v", 30))

    def ref(s):
        if s is None:
            return ""
        try:
            return (datetime.strptime(s, "%Y-%m-%d") + timedelta(days=30)).strftime("%Y-%m-%d")
        except ValueError:
            return s
    assert got == [ref(v) for v in vals]
    diff = _run(spark, vals, fn.date_diff_days("v", F.lit("2024-03-01")))

    def ref_d(s):
        try:
            return (datetime.strptime("2024-03-01", "%Y-%m-%d") - datetime.strptime(s, "%Y-%m-%d")).days
        except (ValueError, TypeError):
            return 0
    assert diff == [ref_d(v) for v in vals]


def test_date_patterns(spark):
    vals = ["20231208", "20230101", "20231301", None]
    assert _run(spark, vals, fn.quarter_of("v")) == ["Q4", "Q1", "Q4", "Q4"]
    assert _run(spark, vals, fn.readable_date("v")) == ["December 08, 2023", "January 01, 2023", None, None]
    # 2023-12-08 is a Friday -> 5 (0 = Sunday)
    assert _run(spark, vals, fn.weekday_number("v")) == ["5", "0", None, None]
    assert _run(spark, vals, fn.prev_month_end("v")) == ["2023-11-30", "2022-12-31", None, None]
    assert _run(spark, vals, fn.date_component("v", "day_name"))[0] == "Friday"
    assert _run(spark, vals, fn.date_component("v", "bogus")) == [None] * 4
    assert _run(spark, vals, fn.convert_sap_date("v", "DD.MM.YYYY"))[0] == "08.12.2023"


JSONS = [None, '{"k": 69}', '{"k": "txt"}', '{"k": true}', '{"k": null}', "[1, 2]", "42", "{bad", '{"a": {"k": 1}}']


def test_json_functions(spark):
    def ref_valid(s):
        if s is None:
            return False
        try:
            json.loads(s)
            return True
        except ValueError:
            return False
    assert _run(spark, JSONS, fn.is_valid_json("v")) == [ref_valid(s) for s in JSONS]
    got = _run(spark, JSONS, fn.json_extract_value("v", "k"))
    # JSON null prints "" here (Python prints "None"); everything else as str(value)
    assert got == ["", "69", "txt", "True", "", "", "", "", ""]


def test_email_phone(spark):
    vals = ["a.b@c.de", " x@y.com ", "bad@x", "a@b.c", None, "+49 (30) 123-4567", "12-34", "1234567890123456"]
    assert _run(spark, vals, fn.is_email("v")) == [True, True, False, False, False, False, False, False]
    assert _run(spark, vals, fn.is_phone("v")) == [False, False, False, False, False, True, False, False]


def test_string_patterns(spark):
    vals = ["single", "two words here", None, "a b"]
    assert _run(spark, vals, fn.after_first_word("v", 3)) == ["single", "wor", None, "b"]
    n, flag = fn.length_flag(F.col("v"), 5, "LONG", "SHORT")
    assert _run(spark, vals, flag) == ["LONG", "LONG", "SHORT", "SHORT"]
    assert _run(spark, ["a-b c!d", None], fn.clean_special_characters("v")) == ["ab cd", None]


def test_sqlite_builtins(spark):
    assert _run(spark, ["12abc", "abc", " -7 ", None], fn.sqlite_int("v")) == [12, 0, -7, None]
    assert _run(spark, [7, -7, 0], fn.sqlite_div("v", F.lit(2)), "int") == [3, -3, 0]


def test_register_sql_functions(spark):
    names = fn.register_sql_functions(spark)
    assert "proper_case" in names
    row = spark.sql("SELECT proper_case(\"o'neil 3rd\") a, left_pad('7', 3, '0') b, is_email('a@b.de') c, "
                    "safe_divide(1, 0) d, yyyymmdd_to_iso('20240131') e").first()
    assert tuple(row) == ("O'Neil 3Rd", "007", True, 0.0, "2024-01-31")


def test_register_more_sql_functions(spark):
    fn.register_sql_functions(spark)
    row = spark.sql("""SELECT split_string('a,b,c', ',', 1) a, split_string('a,b', ',', 5) b,
                              split_string(NULL, ',', 0) c, json_extract_value('{"k": true}', 'k') d,
                              json_extract_value('{bad', 'k') e, format_date('20240131') f, format_date('20230230') g,
                              date_add_days('2024-01-31', 1) h, date_add_days('bad', 1) i, power_of(-8, 0.5) j,
                              power_of(2, 10) k""").first()
    assert tuple(row) == ("b", "", "", "True", "", "2024-01-31", "20230230", "2024-02-01", "bad", 0.0, 1024.0)
