"""JSON text functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions._util import text


def json_extract_value(j: Any, key: str) -> Column:
    """Value of a top-level key as text; missing key, bad JSON, non-object
    JSON or NULL -> "".  Booleans print as Python does (``True``); nested values
    stay JSON text and JSON null gives "" (the reference prints ``None``)."""
    if key is None:
        return F.lit("")
    safe_key = str(key).replace("\\", "\\\\").replace("'", "\\'")
    raw = F.get_json_object(text(j), f"$['{safe_key}']")
    shown = F.when(raw == "true", F.lit("True")).when(raw == "false", F.lit("False")).otherwise(raw)
    return F.coalesce(shown, F.lit(""))


def is_valid_json(s: Any) -> Column:
    """Any JSON value (object, array, scalar) is valid; NULL -> False."""
    return F.coalesce(F.try_parse_json(text(s)).isNotNull(), F.lit(False))
