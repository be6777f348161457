"""Text checks (E18-E20) and Python-float parsing used by the numeric functions.

The parsers are written to reference their input few times: every reference
is generated code, and large generated methods are not JIT-compiled."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions._util import col, is_ascii, text

# The e-mail pattern checked by the reference's is_email
# (surrounding whitespace allowed here because the reference strips first).
EMAIL_PATTERN = r"(?U)^\s*[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\s*\z"

# Python float() syntax: digits with single underscores between them, optional
# fraction and exponent, or inf/infinity/nan, with an optional sign and
# surrounding whitespace.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_MANTISSA = r"(?:" + _DIGITS + r"(?:\.(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
NUMERIC_TEXT_PATTERN = (r"(?U)^\s*[+-]?(?:" + _MANTISSA + r"(?:[eE][+-]?" + _DIGITS + r")?"
                        r"|(?i:inf|infinity|nan))\s*\z")
_STARTS = list("0123456789+-.iInN \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")


def _maybe_number(raw: Column) -> Column:
    """The first character can start a Python float (digit, sign, dot, i/n of
    inf/nan, whitespace, or non-ASCII); everything else skips all parsing."""
    first = F.substring(raw, 1, 1)
    return first.isin(*_STARTS) | (F.ascii(first) > 127)


def is_numeric(s: Any) -> Column:
    """Stripped, non-empty and accepted by Python ``float()``; NULL -> False."""
    raw = text(s)
    return F.coalesce(F.when(_maybe_number(raw), raw.rlike(NUMERIC_TEXT_PATTERN)), F.lit(False))


def py_float(s: Any) -> Column:
    """Python ``float(x)`` as a Column: numbers pass through, text parses with
    Python's syntax (``1_000``, `` 12 ``, ``nan``), anything else -> NULL.

    The input type is tested with ``typeof``, which Catalyst folds to a
    constant, so numeric columns compile to a plain cast.  Text that looks
    like a plain number (no ``d``/``f``/``x``/``_``, which Java or Python read
    differently) uses Spark's cast; only the rest meets the full pattern."""
    c = col(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    t = c.cast("string")
    plain = F.length(F.translate(t, "dDfFxX_", "")) == F.length(t)
    fast = F.when(plain, t.try_cast("double"))
    slow = F.when(t.rlike(NUMERIC_TEXT_PATTERN), F.regexp_replace(t, r"(?U)^\s+|\s+$|_", "").try_cast("double"))
    parsed = F.when(_maybe_number(t), F.coalesce(fast, slow))
    return F.when(F.typeof(c).isin("string", "void"), parsed).otherwise(c.try_cast("double"))


def is_email(s: Any) -> Column:
    """Stripped text matches the fixed e-mail pattern; NULL -> False.
    (Texts without an ``@`` skip the pattern.)"""
    t = text(s)
    return F.coalesce(F.when(t.contains("@"), t.rlike(EMAIL_PATTERN)), F.lit(False))


def is_phone(s: Any) -> Column:
    """7 to 15 digits once every non-digit is removed; NULL -> False.
    ASCII text counts its digits with ``translate``; other text uses the
    Unicode digit class (Python's ``\\d``)."""
    t = text(s)
    ascii_digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    unicode_digits = F.length(F.regexp_replace(t, r"(?U)[^\d]+", ""))
    n = F.when(is_ascii(t), ascii_digits).otherwise(unicode_digits)
    # fewer than 7 characters cannot hold 7 digits: skip the counting
    return F.coalesce(F.when(F.length(t) >= 7, n.between(7, 15)), F.lit(False))


#: Characters that part the tokens of a text.
TOKEN_SEPARATORS = r" \t\n\r"
_OTHER_SPACE = r"[\s&&[^" + TOKEN_SEPARATORS + r"]]*+"
#: What a token may be: tests whose outcome is known from the whole token.
_TOKEN_BODIES = {
    "email": _OTHER_SPACE + r"[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}+" + _OTHER_SPACE,
    "phone": r"(?:[^" + TOKEN_SEPARATORS + r"\p{Nd}]*+\p{Nd}){7,15}+[^" + TOKEN_SEPARATORS + r"\p{Nd}]*+",
    "numeric": _OTHER_SPACE + r"[+-]?(?:" + _MANTISSA + r"(?:[eE][+-]?" + _DIGITS + r")?|(?i:inf|infinity|nan))" + _OTHER_SPACE,
}


def count_tokens(s: Any, kind: str) -> Column:
    """How many tokens of a text (parted by blanks, tabs and line ends) are an
    ``email`` (E18), ``numeric`` (E19) or ``phone`` (E20): one pass over the whole
    text, no array of tokens; NULL -> NULL."""
    t = text(s)
    n = F.regexp_count(t, F.lit(r"(?U)(?<![^" + TOKEN_SEPARATORS + "])" + _TOKEN_BODIES[kind] + "(?![^" + TOKEN_SEPARATORS + "])"))
    return (F.when(t.contains("@"), n).when(t.isNotNull(), F.lit(0)) if kind == "email" else n).cast("long")
