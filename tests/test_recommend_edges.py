"""Recommendation edge cases: grain mismatch, missing totals, equal extremes, sorts."""
from bidscope.operators import recommend


def _totals(spark, rows):
    return spark.createDataFrame(rows, "rfq_id string, supplier_name string, total_quoted_cost double, "
                                       "savings_vs_cheapest double, rank int")


def _gaps(spark, rows):
    return spark.createDataFrame(rows, "rfq_id string, quote_seq long, supplier_name string, gap_score double")


def test_grain_mismatch_and_fill(spark):
    t = _totals(spark, [("r", "A", 100.0, 0.0, 1), ("r", "B", 200.0, 100.0, 2), ("r", "C", 150.0, 50.0, 2)])
    g = _gaps(spark, [("r", 1, "A", 4.0), ("r", 2, "A", 1.0), ("r", 3, "B", 2.0)])
    fan = recommend.recommendation(t, g).collect()
    assert len(fan) == 4                                   # A fans out: two quotations
    c = [r for r in fan if r.supplier_name == "C"][0]
    assert c.gap_score == 4.0                              # missing gap takes the RFQ's highest
    one = {r.supplier_name: r for r in recommend.recommendation(t, g, per_supplier=True).collect()}
    assert len(one) == 3 and one["A"].gap_score == 1.0


def test_no_totals_and_equal_extremes(spark):
    t = _totals(spark, [("r", "A", None, None, None), ("r", "B", None, None, None),
                        ("s", "X", 5.0, 0.0, 1), ("s", "Y", 5.0, 0.0, 1)])
    g = _gaps(spark, [("r", 1, "A", 2.0), ("r", 2, "B", 2.0), ("s", 3, "X", 0.0), ("s", 4, "Y", 3.0)])
    r = {x.supplier_name: x for x in recommend.recommendation(t, g).collect()}
    assert r["A"].composite_score == 0.0 and r["B"].composite_score == 0.0   # no totals: cost 0, equal gaps
    assert r["X"].composite_score == 0.0 and r["Y"].composite_score == 0.4   # equal totals: range 1
    best = {x.rfq_id: x.supplier_name for x in recommend.best_supplier(recommend.recommendation(t, g)).collect()}
    assert best == {"r": "A", "s": "X"}


def test_sorts(spark):
    t = _totals(spark, [("r", "B", None, None, None), ("r", "A", 9.0, 0.0, 1), ("r", "C", 9.0, 0.0, 1)])
    assert [x.supplier_name for x in recommend.sort_by_total(t).collect()] == ["A", "C", "B"]
