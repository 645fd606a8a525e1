"""Scalar functions: edge cases and the semantic traps."""
from pyspark.sql import functions as F

from bidscope.functions.aliases import HEADER_FIELD_ALIASES, ITEM_COLUMN_ALIASES, match_alias
from bidscope.functions.terms import (advance_pct, clean_number, infer_currency, normalize_date,
                                      parse_iso_date)
from bidscope.functions.text import normalize_key, strip
from bidscope.operators.compare import impute_total


def one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clean_number(spark):
    vals = ["Rs. 1,250.50", "1,00,000.50", "12.", ".5", "5-7 days", "n/a", None, "₹ 99", "USD -3", "३० kg"]
    assert one(spark, vals, clean_number) == [1250.5, 100000.5, 12.0, 5.0, 5.0, None, None, 99.0, -3.0, 30.0]


def test_normalize_date(spark):
    vals = ["15/09/2026", "5-9-26", "31/13/2026", "2026-09-15", "soon", "", None, "Due 5/9/026"]
    assert one(spark, vals, normalize_date) == [
        "2026-09-15", "2026-09-05", "2026-13-31", "2015-09-26", None, None, None, "20026-09-05"]
    assert one(spark, ["2026-09-15", "15/09/2026"], lambda c: normalize_date(c, iso_first=True)) == [
        "2026-09-15", "2026-09-15"]
    assert one(spark, ["2026-13-31", "2026-09-15", None], parse_iso_date)[0] is None


def test_advance_pct(spark):
    vals = ["30% advance", "100 % UPFRONT", "250% advance", "12.5% advance", "Advance 30%",
            "३०% advance", None, "50% in advance", "Net 30"]
    assert one(spark, vals, advance_pct) == [30.0, 100.0, 100.0, 5.0, None, 30.0, None, 50.0, None]


def test_match_alias_and_traps(spark):
    item = lambda c: match_alias(c, ITEM_COLUMN_ALIASES)
    head = lambda c: match_alias(c, HEADER_FIELD_ALIASES)
    # trap: "unit" precedes "unit_price" and prefix matching is first-field-wins
    assert one(spark, ["Unit Price", "Unit Price (INR)", "Total Price (INR)", "Item Code", "Remarks"], item) == [
        "unit_price", "unit", "total_price", "item_name", None]
    assert one(spark, ["Unit Price (INR)"], lambda c: match_alias(c, ITEM_COLUMN_ALIASES, True)) == ["unit_price"]
    assert one(spark, [" Lead  Time (days)", "Payment Terms Required", "Note", "RFQ"], head) == [
        "delivery_lead_time_days", "payment_terms", None, "rfq_ref"]


def test_strip_matches_python(spark):
    vals = ["  a b \t", "　x ", "  ", "k"]
    assert one(spark, vals, strip) == [v.strip() for v in vals]
    assert one(spark, ["  Lead   Time\t(days) "], normalize_key) == ["lead time (days)"]


def test_infer_currency(spark):
    assert one(spark, ["₹ 5 or $5", "USD 9", "hours", "Rs. 10", "price $3", "inr"], infer_currency) == [
        "INR", "USD", None, "INR", "USD", "INR"]


def test_imputed_total(spark):
    df = spark.createDataFrame([(2.0, 3.5, None), (2.0, None, None), (2.0, 3.5, 9.0)],
                               "quantity double, unit_price double, total_price double")
    assert [r[0] for r in df.select(impute_total()).collect()] == [7.0, None, 9.0]
