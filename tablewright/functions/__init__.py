"""Scalar functions as native Column expressions."""

from tablewright.functions.text import (
    regexp_replace, regexp_match, regexp_extract, split_string, reverse_string, proper_case,
    left_pad, right_pad, leading_zeros, handle_sap_leading_zeros, clean_special_characters, after_first_word, length_flag,
    java_pattern, java_replacement,
)
from tablewright.functions.numbers import (
    safe_divide, percentage, power_of, sqlite_log, sqlite_int, sqlite_div, concat_op,
)
from tablewright.functions.dates import (
    date_add_days, date_diff_days, format_date, yyyymmdd_to_iso, convert_sap_date, date_text,
    date_part_by_position, date_component, day_of, month_of, year_of, quarter_of, day_name,
    prev_month_end, system_date, weekday_number, readable_date, strftime_to_spark,
)
from tablewright.functions.jsons import json_extract_value, is_valid_json
from tablewright.functions.checks import count_tokens, is_numeric, is_email, is_phone, py_float
from tablewright.functions.register import register_sql_functions

__all__ = [n for n in dir() if not n.startswith("_")]
