"""Numeric functions (E9-E11) and SQLite built-ins that differ in Spark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions._util import col, lit
from tablewright.functions.checks import py_float


def _num(x: Any) -> Column:
    """Argument as double the way the reference reads it: NULL -> 0.0,
    unparsable -> NULL (which the callers turn into their error value).
    Each operand is parsed once."""
    if x is None:
        return F.lit(0.0)
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    c = col(x)
    return F.when(c.isNull(), F.lit(0.0)).otherwise(py_float(c))


def safe_divide(a: Any, b: Any, default: float = 0.0) -> Column:
    """A / b; NULL a -> 0; NULL or zero b -> default; non-numeric -> default.
    (A bad operand parses to NULL, the division is NULL, and the final
    ``coalesce`` gives the default -- as the reference's exception path.)"""
    num, den = _num(a), _num(b)
    d = F.lit(float(default if default is not None else 0.0))
    return F.coalesce(F.when(den == 0, d).otherwise(num / den), d)


def percentage(part: Any, whole: Any, decimals: int = 2) -> Column:
    """round(part / whole * 100, decimals); zero/NULL whole or bad input -> 0.0.
    (Spark rounds half-up on the decimal value; Python rounds the binary double.)"""
    p, w = _num(part), _num(whole)
    return F.coalesce(F.when(w == 0, F.lit(0.0)).otherwise(F.round(p / w * 100, int(decimals))), F.lit(0.0))


def power_of(a: Any, b: Any) -> Column:
    """A ** b with NULL operands as 0.0; where ``math.pow`` raises -- a
    negative base with a fractional exponent, zero to a negative power, or an
    overflow from finite inputs -- 0.0; bad text -> 0.0."""
    x, y = _num(a), _num(b)
    r = F.pow(x, y)
    domain = ((x < 0) & (y != F.floor(y))) | ((x == 0) & (y < 0))
    overflow = (F.abs(r) == float("inf")) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    return F.coalesce(F.when(domain | overflow, F.lit(0.0)).otherwise(r), F.lit(0.0))


# ---------------------------------------------------------------- E21 SQLite built-ins

def sqlite_log(x: Any) -> Column:
    """SQLite ``log(x)`` is base 10."""
    return F.log10(col(x))


def sqlite_int(x: Any) -> Column:
    """SQLite ``CAST(x AS INTEGER)``: leading integer prefix of the text, 0 when
    there is none, NULL stays NULL."""
    t = F.trim(col(x).cast("string"))
    lead = F.regexp_extract(t, r"^[+-]?\d+", 0)
    return F.when(t.isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce(lead.try_cast("long"), F.lit(0).cast("long")))


def sqlite_div(a: Any, b: Any) -> Column:
    """SQLite integer division (truncates toward zero); division by zero -> NULL."""
    x, y = col(a).cast("long"), col(b).cast("long")
    return F.when(y == 0, F.lit(None).cast("long")).otherwise(((x - (x % y)) / y).cast("long"))


def concat_op(*cols: Any) -> Column:
    """``a || b``: NULL if any part is NULL (Spark ``concat`` agrees)."""
    return F.concat(*[lit(c) for c in cols])
