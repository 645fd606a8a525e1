"""Numbers, dates and payment terms out of free text (all JVM expressions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, fold_digits, is_falsy_str

# Fixed patterns (must behave like the reference's).
CURRENCY_NOISE = r"(?i)[₹$]|rs\.?|inr|usd"
NUMBER = r"-?\d[\d,]*\.?\d*"
DMY_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
ADVANCE = r"(?i)(\d{1,3})\s*%\s*(?:advance|upfront|in advance)"
INR_WORD = r"(?i)\bINR\b|\bRs\.?\b"
USD_WORD = r"(?i)\bUSD\b"


def _nz(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def clean_number(c) -> Column:
    """Money/quantity text -> DOUBLE: drop currency marks, take the first
    signed digits-and-commas run with optional fraction, drop commas.
    (Numeric columns need no cleaning: cast them instead.)"""
    s = F.regexp_replace(fold_digits(col_(c)), CURRENCY_NOISE, "")
    num = F.regexp_replace(F.regexp_extract(s, NUMBER, 0), ",", "")
    return _try_double(_nz(num))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def normalize_date(c, iso_first: bool = False) -> Column:
    """First d/m/y date (2-4 digit year, 2-digit years get '20'), written as
    yyyy-MM-dd without range checks; else a leading ISO date; else NULL.

    The d/m/y search is unanchored, so by default an ISO input such as
    2026-09-15 reads as 26-09-15 (reference behaviour). ``iso_first=True``
    tests the ISO prefix first.
    """
    s = fold_digits(col_(c).cast("string"))
    d, m, y = (F.regexp_extract(s, DMY_DATE, i) for i in (1, 2, 3))
    dmy = F.concat_ws("-", F.when(F.length(y) == 4, y).otherwise(F.concat(F.lit("20"), y)),
                      F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    iso = F.when(s.rlike(ISO_PREFIX), F.substring(s, 1, 10))
    has_dmy = s.rlike(DMY_DATE)
    out = (F.when(iso.isNotNull(), iso).when(has_dmy, dmy) if iso_first
           else F.when(has_dmy, dmy).otherwise(iso))
    return F.when(is_falsy_str(s), None).otherwise(out)


def parse_iso_date(c) -> Column:
    """yyyy-MM-dd text -> DATE, NULL when it does not parse (ANSI-safe)."""
    return F.try_to_date(col_(c), "yyyy-MM-dd")


def advance_pct(c) -> Column:
    """Advance percentage from payment terms: 1-3 digits, '%', then
    advance/upfront; capped at 100; NULL when absent."""
    s = fold_digits(col_(c))
    pct = _try_double(_nz(F.regexp_extract(s, ADVANCE, 1)))
    return F.when(pct.isNotNull(), F.least(pct, F.lit(100.0)))


def infer_currency(c) -> Column:
    """INR when the text has the rupee sign or the word INR/Rs; else USD when
    it has '$' or the word USD; else NULL."""
    s = col_(c)
    return (F.when(s.contains("₹") | s.rlike(INR_WORD), F.lit("INR"))
             .when(s.contains("$") | s.rlike(USD_WORD), F.lit("USD")))
