"""Shared helpers for the Column-expression functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Any) -> Column:
    """Column name or Column -> Column."""
    return c if isinstance(c, Column) else F.col(c)


def lit(v: Any) -> Column:
    """Python value or Column -> Column."""
    return v if isinstance(v, Column) else F.lit(v)


def text(c: Any) -> Column:
    """Any column as text (the reference applies ``str()`` to every argument)."""
    return col(c).cast("string")


# Python's str.strip() removes all Unicode whitespace; Spark's trim() only spaces.
_STRIP_RE = r"(?U)^\s+|\s+$"
# The ASCII characters Python's str.isspace() accepts.
ASCII_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def is_ascii(c: Column) -> Column:
    """Cheap exact test: UTF-8 byte length equals character length."""
    return F.octet_length(c) == F.length(c)


def py_strip(c: Column) -> Column:
    """``str.strip()``: ASCII text with a character trim, other text with the
    Unicode whitespace pattern."""
    return F.when(is_ascii(c), F.btrim(c, F.lit(ASCII_SPACES))).otherwise(F.regexp_replace(c, _STRIP_RE, ""))
