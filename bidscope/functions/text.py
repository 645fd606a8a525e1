"""String column builders: blank tests, key normalisation, defaults.

All return ``Column`` expressions so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Devanagari digits zero..nine, mapped to ASCII before any
# numeric regex (Java's \d is ASCII-only, Python's is Unicode).
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ASCII_DIGITS = "0123456789"

# Leading/trailing whitespace as Python's str.strip() sees it for the
# characters that occur in practice (ASCII whitespace, NBSP, Unicode spaces).
_WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u0085\u001C-\u001F]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.isspace() accepts (derived by rule).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c) -> Column:
    """Python-style ``str.strip()`` (Spark ``trim`` only removes U+0020):
    ``btrim`` with the whitespace set, no regex."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def is_falsy_str(c) -> Column:
    """Python truthiness for an optional string: None or '' is falsy."""
    c = col_(c)
    return c.isNull() | (c == "")


def is_falsy_num(c) -> Column:
    """Python truthiness for an optional number: None or 0 is falsy."""
    c = col_(c)
    return c.isNull() | (c == 0)


def or_default(c, default: str) -> Column:
    """``x or default`` for a string column."""
    c = col_(c)
    return F.when(is_falsy_str(c), F.lit(default)).otherwise(c)


def fold_digits(c) -> Column:
    return F.translate(col_(c), DEVANAGARI_DIGITS, ASCII_DIGITS)


def normalize_key(c) -> Column:
    """strip, lower-case, collapse whitespace runs to one space."""
    return F.regexp_replace(F.lower(strip(c)), f"{_WS}+", " ")
