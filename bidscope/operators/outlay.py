"""Cash outlay per supplier: advance share of the total from payment terms.

Money is rounded on exact decimals (half-up to the cent) rather than on
binary doubles, so every engine gives the same cents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import advance_pct
from ..functions.text import or_default
from .compare import UNKNOWN_SUPPLIER

MONEY = "decimal(20,2)"


def supplier_terms(quotations: DataFrame) -> DataFrame:
    """Per (rfq, supplier) the terms of the supplier's last quotation
    (a later quotation replaces an earlier one): ``max_by`` over the list
    position, a partial aggregate."""
    q = quotations.withColumn("supplier_name", or_default("supplier_name", UNKNOWN_SUPPLIER))
    last = F.max_by(F.struct("payment_terms", "delivery_lead_time_days"), F.col("quote_seq"))
    return (q.groupBy("rfq_id", "supplier_name").agg(last.alias("_t"))
             .select("rfq_id", "supplier_name", "_t.payment_terms", "_t.delivery_lead_time_days"))


def cash_outlay(quotations: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals (from ``total_cost_summary``) + terms lookup -> advance %,
    upfront cash and balance on delivery."""
    t = totals.select("rfq_id", "supplier_name", "total_quoted_cost")
    j = t.join(supplier_terms(quotations), ["rfq_id", "supplier_name"], "left")
    pct = advance_pct("payment_terms")
    total_d = F.col("total_quoted_cost").cast(MONEY)
    upfront_d = F.round(total_d * pct.cast("decimal(6,2)") * F.lit(0.01).cast("decimal(3,2)"), 2)
    has = F.col("total_quoted_cost").isNotNull() & pct.isNotNull()
    return j.select(
        "rfq_id", "supplier_name", "total_quoted_cost",
        or_default("payment_terms", "Not specified").alias("payment_terms"),
        pct.alias("advance_payment_pct"),
        F.when(has, upfront_d.cast("double")).alias("upfront_cash_required"),
        F.when(has, (total_d - upfront_d).cast("double")).alias("balance_on_delivery"),
        "delivery_lead_time_days")
