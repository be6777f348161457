"""Regex and string functions (E1-E8, E22, P1-P3) as native Column expressions.

Each mirrors the reference's SQL function contract (NULL -> "" etc., see
SURVEY 1.1) while staying inside whole-stage codegen: no Python UDF.
Patterns given as Python strings are translated to the Java dialect on the
driver, and checked there, because Spark raises on a bad pattern where the
reference returns its fallback value.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions._util import lit, text


# ---------------------------------------------------------------- regex dialect

def _inline_flags(flags: str | None) -> str:
    """Python flags as Java inline flags; ``U`` always, because Python's
    ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are Unicode-aware on text."""
    f = "".join(ch for ch in "ims" if flags and ch in str(flags).lower())
    return f"(?U{f})"


def java_pattern(pattern: str) -> str:
    """Python ``re`` syntax -> Java regex syntax for the constructs that differ."""
    p = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    p = p.replace(r"\Z", r"\z")
    return p


def java_replacement(rep: str) -> str:
    """Python replacement template -> Java: ``\\1``/``\\g<1>``/``\\g<name>`` become
    ``$1``/``${name}``; a literal ``$`` is escaped."""
    out = []
    i = 0
    while i < len(rep):
        ch = rep[i]
        if ch == "$":
            out.append(r"\$")
        elif ch == "\\" and i + 1 < len(rep):
            nxt = rep[i + 1]
            m = re.match(r"\\g<(\w+)>", rep[i:])
            if nxt.isdigit():
                j = i + 1
                while j < len(rep) and rep[j].isdigit() and j < i + 3:
                    j += 1
                out.append("$" + rep[i + 1:j])
                i = j
                continue
            if m:
                name = m.group(1)
                out.append("$" + name if name.isdigit() else "${" + name + "}")
                i += len(m.group(0))
                continue
            escapes = {"n": "\n", "t": "\t", "r": "\r", "\\": r"\\"}
            out.append(escapes.get(nxt, "\\" + nxt))
            i += 2
            continue
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _compiles(pattern: str, flags: str | None = None) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:
        return None


# ---------------------------------------------------------------- E1-E3

def regexp_replace(s: Any, pattern: str | None, replacement: str | None = "",
                   flags: str | None = None) -> Column:
    """Global replace; NULL s -> ""; NULL/empty pattern -> s; NULL
    replacement -> ""; bad pattern -> s; flags i/m/s (g is implied)."""
    base = F.coalesce(text(s), F.lit(""))
    if pattern is None or pattern == "" or _compiles(pattern) is None:
        return base
    rep = "" if replacement is None else java_replacement(str(replacement))
    replaced = F.regexp_replace(text(s), F.lit(_inline_flags(flags) + java_pattern(pattern)), F.lit(rep))
    return F.coalesce(replaced, F.lit(""))


def regexp_match(pattern: str | None, s: Any, flags: str | None = None) -> Column:
    """Search anywhere; NULL input or bad pattern -> False."""
    if pattern is None or _compiles(pattern) is None:
        return F.lit(False)
    return F.coalesce(text(s).rlike(_inline_flags(flags) + java_pattern(pattern)), F.lit(False))


def regexp_extract(pattern: str | None, s: Any, group: int = 0, flags: str | None = None) -> Column:
    """Group of the first match; no match / NULL / bad group -> NULL.
    (An optional group that took no part in the match gives "" in Spark.)"""
    compiled = None if pattern is None else _compiles(pattern)
    if compiled is None or group is None or int(group) < 0 or int(group) > compiled.groups:
        return F.lit(None).cast("string")
    p = _inline_flags(flags) + java_pattern(pattern)
    s = text(s)
    return F.when(s.rlike(p), F.regexp_extract(s, p, int(group)))


# ---------------------------------------------------------------- E4-E8

def split_string(s: Any, delimiter: Any = ",", index: Any = None) -> Column:
    """Literal delimiter, 0-based index; out of range / negative -> "";
    no index -> s unchanged; NULL s -> ""; NULL delimiter -> ","; empty
    delimiter -> s."""
    s = F.coalesce(text(s), F.lit(""))
    d = F.coalesce(lit(delimiter).cast("string"), F.lit(","))
    if index is None:
        return s
    i = lit(index).try_cast("int")
    part = F.split_part(s, d, F.greatest(i, F.lit(0)) + F.lit(1))
    return (F.when(d == "", s)
            .when(i.isNull(), s if not isinstance(index, Column) else F.lit(""))
            .when(i < 0, F.lit(""))
            .otherwise(part))


def reverse_string(s: Any) -> Column:
    """E5: NULL -> ""."""
    return F.reverse(F.coalesce(text(s), F.lit("")))


def proper_case(s: Any) -> Column:
    """Python ``str.title()``: upper-case the first letter of every letter
    run, lower-case the rest ("o'neil 3rd a-b" -> "O'Neil 3Rd A-B"); NULL -> "".
    (Characters whose title case differs from their upper case, such as
    "ß" -> "Ss" or the "ǆ" digraphs, take the upper case here.)"""
    runs = F.regexp_extract_all(F.coalesce(text(s), F.lit("")), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))),
        "")


def _pad(s: Any, length: Any, pad_char: Any, left: bool) -> Column:
    s = F.coalesce(text(s), F.lit(""))
    n = lit(length).try_cast("int")
    if isinstance(pad_char, Column):
        ch = F.when(F.coalesce(F.length(pad_char), F.lit(0)) == 0, F.lit(" ")).otherwise(F.left(pad_char, F.lit(1)))
    else:
        ch = F.lit(str(pad_char)[0] if pad_char else " ")
    padded = F.lpad(s, n, ch) if left else F.rpad(s, n, ch)
    # Python rjust/ljust never truncate; Spark lpad/rpad do.
    return F.when(n.isNull() | (F.length(s) >= n), s).otherwise(padded)


def left_pad(s: Any, length: Any, pad_char: Any = " ") -> Column:
    """Pad on the left with the first char of ``pad_char``; never truncates."""
    return _pad(s, length, pad_char, left=True)


def right_pad(s: Any, length: Any, pad_char: Any = " ") -> Column:
    """As E7, on the right."""
    return _pad(s, length, pad_char, left=False)


def leading_zeros(s: Any, length: int = 10) -> Column:
    """Zero-pad keys to a fixed width (never truncates)."""
    return left_pad(s, length, "0")


# ---------------------------------------------------------------- P1-P3

def clean_special_characters(s: Any) -> Column:
    """Keep only ASCII letters, digits and spaces (NULL stays NULL)."""
    return F.regexp_replace(text(s), r"[^a-zA-Z0-9 ]+", "")   # runs at once: same result, fewer steps


def after_first_word(s: Any, length: int) -> Column:
    """A text without spaces stays as it is; otherwise the first ``length``
    characters after the first space."""
    s = text(s)
    pos = F.instr(s, " ")
    return F.when(pos == 0, s).otherwise(F.substring(F.substr(s, pos + 1), 1, int(length)))


def length_flag(s: Any, threshold: int, above: Any, otherwise: Any) -> tuple[Column, Column]:
    """(length, flag) where flag = ``above`` if length > threshold else
    ``otherwise`` (NULL length -> ``otherwise``)."""
    n = F.length(text(s))
    return n, F.when(n > F.lit(threshold), lit(above)).otherwise(lit(otherwise))


# The documented helper name.
handle_sap_leading_zeros = leading_zeros
