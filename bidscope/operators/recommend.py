"""Supplier recommendation: min-max normalised cost and gap score per RFQ,
combined 60/40; lowest composite wins.

Per-RFQ extremes are one grouped aggregate joined back,
and the winner per RFQ is a ``min(struct)`` aggregate, so no window holds a
whole RFQ.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_window import argmin_struct, positions

# Fixed weights of the composite score.
COST_WEIGHT, GAP_WEIGHT = 0.6, 0.4


def _norm(x: str, lo: str, hi: str):
    rng = F.col(hi) - F.col(lo)
    return (F.col(x) - F.col(lo)) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)


def recommendation(totals: DataFrame, gaps: DataFrame, per_supplier: bool = False) -> DataFrame:
    """``totals``: total_cost_summary output; ``gaps``: gap_analysis output.

    Left join on (rfq, supplier) - one row per gap row, as in the reference
    when a supplier sent several quotations (``per_supplier=True`` keeps one
    row per supplier with its lowest gap score). A missing gap score takes the
    RFQ's highest; cost normalisation is 0 for an RFQ without any total.
    """
    g = gaps.select("rfq_id", "supplier_name", "gap_score")
    if per_supplier:
        # one row per supplier: its lowest (best) gap score
        g = g.groupBy("rfq_id", "supplier_name").agg(F.min("gap_score").alias("gap_score"))
    m = totals.join(g, ["rfq_id", "supplier_name"], "left")
    # One per-RFQ aggregate gives every extreme: a missing gap score is
    # filled with the RFQ's highest, which leaves min and max unchanged.
    ext = m.groupBy("rfq_id").agg(
        F.min("total_quoted_cost").alias("_cmin"), F.max("total_quoted_cost").alias("_cmax"),
        F.min("gap_score").alias("_gmin"), F.max("gap_score").alias("_gmax"))
    m = (m.join(ext, "rfq_id", "left")
          .withColumn("gap_score", F.coalesce("gap_score", "_gmax")))
    cost_norm = F.when(F.col("_cmax").isNull(), F.lit(0.0)).otherwise(
        _norm("total_quoted_cost", "_cmin", "_cmax"))
    gap_norm = _norm("gap_score", "_gmin", "_gmax")
    comp = COST_WEIGHT * cost_norm + GAP_WEIGHT * gap_norm
    return m.select("rfq_id", "supplier_name", "total_quoted_cost", "savings_vs_cheapest",
                    "rank", "gap_score", F.round(comp, 6).alias("composite_score"))


def best_supplier(rec: DataFrame) -> DataFrame:
    """Lowest composite per RFQ (NULL last, then supplier name)."""
    best = argmin_struct(F.col("composite_score").isNull(), "composite_score", "supplier_name",
                         "total_quoted_cost", "gap_score").alias("_b")
    return rec.groupBy("rfq_id").agg(best).select(
        "rfq_id", F.col("_b.supplier_name").alias("supplier_name"),
        F.col("_b.composite_score").alias("composite_score"),
        F.col("_b.total_quoted_cost").alias("total_quoted_cost"),
        F.col("_b.gap_score").alias("gap_score"))


def ordered(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Presentation sort within each RFQ (value ascending, NULL last, then
    explicit tie-breaks, since the reference's sort is not stable)."""
    return df.orderBy("rfq_id", F.col(value).asc_nulls_last(), *ties)


def sort_by_total(totals: DataFrame) -> DataFrame:
    """Totals in ascending cost per RFQ, missing totals last."""
    return ordered(totals, "total_quoted_cost", "supplier_name")


def sort_by_gap(gaps: DataFrame) -> DataFrame:
    """Most complete quotations first per RFQ."""
    return ordered(gaps, "gap_score", "supplier_name", "quote_seq")


def sort_by_composite(rec: DataFrame) -> DataFrame:
    """Recommendation order per RFQ."""
    return ordered(rec, "composite_score", "supplier_name")


def with_position(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """The presentation order as data: ``position`` from 1 within each RFQ, in the order of ``ordered``,
    without gathering an RFQ in one task."""
    placed = positions(df, ["rfq_id"], [F.col(value).asc_nulls_last(), *map(F.col, ties)])
    return placed.withColumn("position", F.col("position") + 1)
