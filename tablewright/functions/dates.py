"""Date functions (E12-E15, E23) and date column patterns.

Dates in the reference are ``YYYYMMDD`` text; Python ``strftime`` codes are
translated to Spark datetime patterns on the driver.  Parsing uses the
``try_*`` forms so dirty input never fails a job (ANSI stays on).
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions._util import col, lit, text

# Strftime code -> Spark datetime pattern letter(s).
STRFTIME_TO_SPARK = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS",
    "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "y": "yy",
    "I": "hh", "p": "a",
}
_LOOSE = {"MM": "M", "dd": "d", "HH": "H", "mm": "m", "ss": "s", "hh": "h"}


def _quote(literal: str) -> str:
    if not literal:
        return ""
    if re.search(r"[A-Za-z']", literal):
        return "'" + literal.replace("'", "''") + "'"
    return literal


def strftime_to_spark(fmt: str, loose: bool = False) -> str:
    """Translate a strftime format.  ``loose`` uses one-letter numeric fields so
    parsing accepts ``2023-1-5`` as Python's ``strptime`` does (only safe where
    fields are separated)."""
    out, buf, i = [], [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            if code == "%":
                buf.append("%")
            else:
                out.append(_quote("".join(buf)))
                buf = []
                pat = STRFTIME_TO_SPARK.get(code)
                if pat is None:
                    raise ValueError(f"unsupported strftime code %{code}")
                out.append(_LOOSE.get(pat, pat) if loose else pat)
            i += 2
        else:
            buf.append(fmt[i])
            i += 1
    out.append(_quote("".join(buf)))
    return "".join(out)


def _has_separators(fmt: str) -> bool:
    return not re.search(r"%[A-Za-z]%[A-Za-z]", fmt)


def _compact_to_date(t: Column) -> Column:
    """``YYYYMMDD`` text -> DATE via an ISO string and ``try_cast`` (invalid
    dates such as 20230230 and the year 0 give NULL).  Much cheaper than a pattern parser
    that fails by exception on every bad row."""
    iso = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2))
    return F.when(t.rlike(r"^(?!0000)[0-9]{8}$"), iso.try_cast("date"))


# What ``strptime`` reads for a numeric code; alternatives in order, the first that fits is taken.
_FIELDS = {"Y": r"(?!0000)\d\d\d\d", "m": "1[0-2]|0[1-9]|[1-9]", "d": r"3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9]", "H": r"2[0-3]|[0-1]\d|\d",
           "M": r"[0-5]\d|\d", "S": r"6[0-1]|[0-5]\d|\d", "f": "[0-9]{1,6}"}
# Fields that a format lacks.
_MISSING = {"Y": "1900", "m": "1", "d": "1", "H": "0", "M": "0", "S": "0", "f": "0"}


def _numeric_fields(fmt: str) -> tuple[str, list[str]] | None:
    """(pattern with a group a field, field codes) of a format of numeric fields,
    each at most once; None for any other."""
    out, codes = "", []
    for code, literal in re.findall(r"(?s)%(.)|([^%]+)", fmt):
        if code in _FIELDS and code not in codes:
            codes.append(code)
            out += f"({_FIELDS[code]})"
        elif code == "%":
            out += "%"
        elif code:
            return None
        else:
            out += "".join(r"\s+" if x.isspace() else re.escape(x) for x in re.split(r"(\s+)", literal) if x)
    return out, codes


def _variable_width(t: Column, fmt: str) -> Column | None:
    """Text -> timestamp as ``strptime`` reads it: a field takes one digit where
    two don't fit, and what is left over makes the text unparsable (the atomic group
    is not read another way to use up a rest).  The fields are put in ISO order, and
    the cast checks the date."""
    found = _numeric_fields(fmt)
    if found is None:
        return None
    pattern, codes = found
    field = {c: f"${codes.index(c) + 1}" if c in codes else x for c, x in _MISSING.items()}
    whole = rf"(?i)\A(?>{pattern})\z"
    iso = F.regexp_replace(t, whole, "{Y}-{m}-{d}T{H}:{M}:{S}.{f}".format(**field))
    return F.when(t.rlike(whole), F.replace(iso, F.lit(" "), F.lit("")).try_cast("timestamp"))


def parse_text_ts(s: Any, fmt: str) -> Column:
    """Text -> timestamp by a strftime format; unparsable -> NULL.  The two
    common date layouts use the cast path where the text has full width; formats
    of numeric fields are read field by field, others by Spark's pattern parser."""
    t = text(s)
    if fmt == "%Y%m%d":
        return F.when(t.rlike("^[0-9]{8}$"), _compact_to_date(t).cast("timestamp")).when(
            t.rlike(r"\A\d{4}[\d ]{2,4}\z"), _variable_width(t, fmt))
    if fmt == "%Y-%m-%d":
        return F.when(t.rlike(r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t.try_cast("date").cast("timestamp")).when(
            t.rlike(r"\A\d{4}-\d{1,2}- \d\z"), _variable_width(t, fmt))
    numeric = _variable_width(t, fmt)
    if numeric is not None:
        return numeric
    strict = F.try_to_timestamp(t, F.lit(strftime_to_spark(fmt)))
    if _has_separators(fmt):
        return F.coalesce(strict, F.try_to_timestamp(t, F.lit(strftime_to_spark(fmt, loose=True))))
    return strict


def date_add_days(d: Any, n: Any, fmt: str = "%Y-%m-%d") -> Column:
    """Add days and print in the same format; NULL date -> ""; unparsable ->
    the input text; NULL days -> 0."""
    t = text(d)
    ts = parse_text_ts(t, fmt)
    days = F.coalesce(lit(n).try_cast("int"), F.lit(0))
    moved = F.timestamp_add("DAY", days, ts)
    return F.when(t.isNull(), F.lit("")).otherwise(
        F.coalesce(F.date_format(moved, strftime_to_spark(fmt)), t))


def date_diff_days(d1: Any, d2: Any, fmt: str = "%Y-%m-%d") -> Column:
    """Whole days from d1 to d2 (``d2 - d1``, floored as ``timedelta.days``);
    NULL or unparsable -> 0."""
    a, b = parse_text_ts(d1, fmt), parse_text_ts(d2, fmt)
    secs = F.unix_seconds(b) - F.unix_seconds(a)
    return F.coalesce(F.floor(secs / 86400).cast("int"), F.lit(0))


def format_date(d: Any, input_format: str = "%Y%m%d", output_format: str = "%Y-%m-%d") -> Column:
    """Re-format a date text; NULL -> ""; unparsable -> the input text."""
    t = text(d)
    ts = parse_text_ts(t, input_format)
    return F.when(t.isNull(), F.lit("")).otherwise(
        F.coalesce(F.date_format(ts, strftime_to_spark(output_format)), t))


def yyyymmdd_to_iso(s: Any) -> Column:
    """``YYYYMMDD`` -> ``YYYY-MM-DD`` by slicing, no validity check; NULL -> NULL."""
    t = text(s)
    return F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2))


def convert_sap_date(s: Any, output_format: str = "YYYY-MM-DD") -> Column:
    """``YYYYMMDD`` text to a layout written as ``YYYY-MM-DD`` / ``DD.MM.YYYY``."""
    fmt = output_format
    for token, code in (("YYYY", "%Y"), ("YY", "%y"), ("MM", "%m"), ("DD", "%d")):
        fmt = fmt.replace(token, code)
    return format_date(s, "%Y%m%d", fmt)


def date_text(ts: Any) -> Column:
    """A timestamp/date column as ``YYYYMMDD`` text (how the tests derive date text)."""
    return F.date_format(col(ts), "yyyyMMdd")


# ---------------------------------------------------------------- P4-P13

def _iso_date(s: Any) -> Column:
    """``YYYYMMDD`` text -> DATE (NULL when it is no real date)."""
    return _compact_to_date(text(s))


def date_part_by_position(s: Any, start: int, length: int) -> Column:
    """``substr(date_text, start, length)``."""
    return F.substring(text(s), int(start), int(length))


def day_of(s: Any) -> Column:
    """Day digits, ``substr(7, 2)``."""
    return F.substring(text(s), 7, 2)


def year_of(s: Any) -> Column:
    """Year digits, ``substr(1, 4)``."""
    return F.substring(text(s), 1, 4)


def month_of(s: Any) -> Column:
    """Month digits, ``substr(5, 2)``."""
    return F.substring(text(s), 5, 2)


def quarter_of(s: Any) -> Column:
    """Q1..Q3 for months 1-9, every other value (13, 00, text, NULL) -> Q4."""
    m = F.substring(text(s), 5, 2).try_cast("int")
    return (F.when(m.between(1, 3), F.lit("Q1"))
            .when(m.between(4, 6), F.lit("Q2"))
            .when(m.between(7, 9), F.lit("Q3"))
            .otherwise(F.lit("Q4")))


def day_name(s: Any) -> Column:
    """Day name (``Monday``) of a ``YYYYMMDD`` text; bad date -> NULL."""
    return F.date_format(_iso_date(s), "EEEE")


def date_component(s: Any, date_type: str) -> Column:
    """P5: day / month / year / quarter / day_name of a ``YYYYMMDD`` text;
    any other type -> NULL."""
    pick = {"day": day_of, "month": month_of, "year": year_of, "quarter": quarter_of,
            "day_name": day_name}.get(date_type)
    return pick(s) if pick else F.lit(None).cast("string")


def prev_month_end(s: Any) -> Column:
    """P10: last day of the previous month as ISO text (first of month minus 1 day)."""
    first = _compact_to_date(F.concat(F.substring(text(s), 1, 6), F.lit("01")))
    return F.date_format(F.date_sub(first, 1), "yyyy-MM-dd")


def system_date(run_date: str | None = None) -> Column:
    """today's date as ISO text; the run date is a parameter so reruns and
    tests are reproducible."""
    if run_date:
        return F.lit(str(run_date))
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def weekday_number(s: Any) -> Column:
    """Weekday with 0 = Sunday (SQLite ``%w``); bad date -> NULL."""
    return (F.dayofweek(_iso_date(s)) - 1).cast("string")


def readable_date(s: Any) -> Column:
    """``December 08, 2023``; bad date -> NULL."""
    return F.date_format(_iso_date(s), "MMMM dd, yyyy")
