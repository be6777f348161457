"""Expose the reference's SQL function names to ``spark.sql`` as SQL functions
(``CREATE TEMPORARY FUNCTION ... RETURN <expr>``): the bodies are SQL
expressions, so they are inlined into the plan and keep codegen -- no Python
UDF is registered."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.functions.checks import EMAIL_PATTERN, NUMERIC_TEXT_PATTERN


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_STRIP = _sql_str(r"(?U)^\s+|\s+$")

_FUNCTIONS = {
    "reverse_string": ("s STRING", "STRING", "reverse(coalesce(s, ''))"),
    "proper_case": ("s STRING", "STRING",
                    "array_join(transform(regexp_extract_all(coalesce(s, ''), '(\\\\p{L}+|[^\\\\p{L}]+)', 1), "
                    "x -> concat(upper(left(x, 1)), lower(substr(x, 2)))), '')"),
    "left_pad": ("s STRING, n INT, c STRING DEFAULT ' '", "STRING",
                 "CASE WHEN n IS NULL OR length(coalesce(s, '')) >= n THEN coalesce(s, '') "
                 "ELSE lpad(coalesce(s, ''), n, CASE WHEN coalesce(c, '') = '' THEN ' ' ELSE left(c, 1) END) END"),
    "right_pad": ("s STRING, n INT, c STRING DEFAULT ' '", "STRING",
                  "CASE WHEN n IS NULL OR length(coalesce(s, '')) >= n THEN coalesce(s, '') "
                  "ELSE rpad(coalesce(s, ''), n, CASE WHEN coalesce(c, '') = '' THEN ' ' ELSE left(c, 1) END) END"),
    "safe_divide": ("a DOUBLE, b DOUBLE, d DOUBLE DEFAULT 0.0", "DOUBLE",
                    "CASE WHEN coalesce(b, 0.0) = 0.0 THEN coalesce(d, 0.0) ELSE coalesce(a, 0.0) / b END"),
    "percentage": ("a DOUBLE, b DOUBLE", "DOUBLE",
                   "CASE WHEN coalesce(b, 0.0) = 0.0 THEN 0.0 ELSE round(coalesce(a, 0.0) / b * 100, 2) END"),
    "is_email": ("s STRING", "BOOLEAN",
                 f"coalesce(s RLIKE {_sql_str(EMAIL_PATTERN)}, false)"),
    "is_numeric": ("s STRING", "BOOLEAN",
                   f"coalesce(s RLIKE {_sql_str(NUMERIC_TEXT_PATTERN)}, false)"),
    "is_phone": ("s STRING", "BOOLEAN",
                 "coalesce(length(regexp_replace(s, '(?U)[^\\\\d]', '')) BETWEEN 7 AND 15, false)"),
    "is_valid_json": ("s STRING", "BOOLEAN", "coalesce(try_parse_json(s) IS NOT NULL, false)"),
    "yyyymmdd_to_iso": ("s STRING", "STRING", "concat(substr(s, 1, 4), '-', substr(s, 5, 2), '-', substr(s, 7, 2))"),
    "split_string": ("s STRING, d STRING, i INT", "STRING",
                     "CASE WHEN s IS NULL THEN '' WHEN coalesce(d, ',') = '' OR i IS NULL THEN s "
                     "WHEN i < 0 THEN '' ELSE split_part(s, coalesce(d, ','), i + 1) END"),
    "json_extract_value": ("j STRING, k STRING", "STRING",
                           "coalesce(CASE get_json_object(j, concat('$[\\'', k, '\\']')) WHEN 'true' THEN 'True' "
                           "WHEN 'false' THEN 'False' ELSE get_json_object(j, concat('$[\\'', k, '\\']')) END, '')"),
    "format_date": ("s STRING", "STRING",
                    "CASE WHEN s IS NULL THEN '' WHEN s RLIKE '^[0-9]{8}$' THEN coalesce(date_format(try_cast(concat("
                    "substr(s, 1, 4), '-', substr(s, 5, 2), '-', substr(s, 7, 2)) AS DATE), 'yyyy-MM-dd'), s) ELSE s END"),
    "date_add_days": ("s STRING, n INT", "STRING",
                      "CASE WHEN s IS NULL THEN '' WHEN s RLIKE '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$' THEN coalesce("
                      "date_format(date_add(try_cast(s AS DATE), coalesce(n, 0)), 'yyyy-MM-dd'), s) ELSE s END"),
    "power_of": ("a DOUBLE, b DOUBLE", "DOUBLE",
                 "CASE WHEN (coalesce(a, 0.0) < 0 AND coalesce(b, 0.0) != floor(coalesce(b, 0.0))) "
                 "OR (coalesce(a, 0.0) = 0 AND coalesce(b, 0.0) < 0) "
                 "OR abs(pow(coalesce(a, 0.0), coalesce(b, 0.0))) = double('Infinity') THEN 0.0 "
                 "ELSE pow(coalesce(a, 0.0), coalesce(b, 0.0)) END"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for name, (params, ret, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(_FUNCTIONS)
