"""Properties of the analytics over the generated tables (sf0.001): rank and
savings agree, totals add up, cash splits add up, composite scores are in
[0, 1], and the count-only gap path equals the full gap analysis."""
from pyspark.sql import functions as F

from bidscope.operators import gaps
from bidscope.plans.registry import QUERIES
from bidscope.sources import star_adapter as star

SF = "/root/testdata/sf0.001"


def test_rank_one_iff_no_savings(spark):
    t = QUERIES["total_cost_rank"](spark, SF)
    bad = t.filter(
        (F.col("total_quoted_cost").isNull() != F.col("rank").isNull())
        | ((F.col("rank") == 1) != (F.col("savings_vs_cheapest") == 0))
        | (F.col("savings_vs_cheapest") < 0))
    assert t.count() > 0 and bad.count() == 0


def test_item_totals_add_up_to_supplier_total(spark):
    items = QUERIES["item_comparison"](spark, SF)
    sums = items.groupBy("rfq_id", "supplier_name").agg(F.sum("total_price").alias("s"))
    t = QUERIES["total_cost_rank"](spark, SF).join(sums, ["rfq_id", "supplier_name"])
    bad = t.filter(F.abs(F.col("s") - F.col("total_quoted_cost")) > 0.01)
    assert t.count() > 0 and bad.count() == 0


def test_upfront_plus_balance_is_total(spark):
    o = QUERIES["cash_outlay"](spark, SF).filter(F.col("upfront_cash_required").isNotNull())
    bad = o.filter(F.abs(F.col("upfront_cash_required") + F.col("balance_on_delivery")
                         - F.col("total_quoted_cost")) > 0.01)
    assert o.count() > 0 and bad.count() == 0


def test_composite_in_unit_interval(spark):
    r = QUERIES["recommendation"](spark, SF).filter(F.col("composite_score").isNotNull())
    bad = r.filter((F.col("composite_score") < 0) | (F.col("composite_score") > 1))
    assert r.count() > 0 and bad.count() == 0


def test_score_only_path_equals_full_gap_analysis(spark):
    qi = star.quote_items(spark, SF)
    args = (star.rfq_items(spark, SF), star.quotations(spark, SF), qi)
    full = gaps.gap_analysis(star.rfqs(spark, SF), *args, with_lists=True)
    fast = gaps.gap_scores(*args)
    counts = gaps.missing_item_counts(*args)
    a = {(r.rfq_id, r.quote_seq): (r.supplier_name, r.gap_score, len(r.missing_item_list))
         for r in full.collect()}
    b = {(r.rfq_id, r.quote_seq): (r.supplier_name, r.gap_score) for r in fast.collect()}
    c = {(r.rfq_id, r.quote_seq): r.n_missing for r in counts.collect()}
    assert len(a) > 0
    assert {k: v[:2] for k, v in a.items()} == b
    assert {k: v[2] for k, v in a.items()} == c
