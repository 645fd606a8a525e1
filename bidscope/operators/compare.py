"""Cost comparison across quotations: item lines, supplier totals with
savings and rank, price matrix (long and wide), cheapest supplier per item.

Input is the long ``quote_items`` table (one row per quoted line, keyed by
``rfq_id``); every per-session result of a single-RFQ tool becomes a
per-``rfq_id`` result here.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_default
from .hot_window import MAX_SPLITS, argmin_struct, positions, split_rank

UNKNOWN_SUPPLIER = "Unknown Supplier"

ITEM_COLUMNS = ["rfq_id", "quote_seq", "item_pos", "item_name", "supplier_name", "quantity",
                "unit", "unit_price", "total_price", "portion", "packaging"]


def impute_total(qty="quantity", price="unit_price", total="total_price"):
    """Given total wins; else quantity x unit price rounded to cents."""
    return F.coalesce(F.col(total), F.round(F.col(qty) * F.col(price), 2))


def item_comparison(quote_items: DataFrame) -> DataFrame:
    """Flattened item lines with default supplier and imputed totals (a pure
    projection: no shuffle)."""
    return quote_items.select(
        "rfq_id", "quote_seq", "item_pos", "item_name",
        or_default("supplier_name", UNKNOWN_SUPPLIER).alias("supplier_name"),
        "quantity", "unit", "unit_price",
        impute_total().alias("total_price"),
        "portion", "packaging")


def total_cost_summary(items: DataFrame, splits: int = MAX_SPLITS) -> DataFrame:
    """Per (rfq, supplier): total in cents (NULL when no line has a total), savings
    against the cheapest supplier of the RFQ, and min-rank of the total.

    Line totals are summed as decimals with eight places, so the order of
    addition never matters and parts of a cent count; only the total is rounded. Shuffles: one partial/final aggregate on (rfq, supplier); rank is
    ``split_rank``, whose per-RFQ aggregate also yields the RFQ's minimum.
    """
    exact = F.col("total_price").cast("decimal(30,8)")
    totals = items.groupBy("rfq_id", "supplier_name").agg(
        F.round(F.sum(exact), 2).cast("decimal(28,2)").alias("total_quoted_cost"))
    ranked = split_rank(totals, ["rfq_id"], "total_quoted_cost", "rank", splits,
                        extra={"_min_total": F.min("total_quoted_cost")})
    return ranked.select(
        "rfq_id", "supplier_name", F.col("total_quoted_cost").cast("double").alias("total_quoted_cost"),
        (F.col("total_quoted_cost") - F.col("_min_total")).cast("double").alias("savings_vs_cheapest"),
        "rank")


def price_matrix(items: DataFrame, value_col: str = "unit_price") -> DataFrame:
    """Long form of the item x supplier matrix: the first non-NULL value in
    list order per (rfq, item, supplier); rows without item or value vanish
    like in a pivot. ``min_by`` is a partial aggregate."""
    v = F.col(value_col)
    return (items.filter(v.isNotNull() & F.col("item_name").isNotNull())
            .groupBy("rfq_id", "item_name", "supplier_name")
            .agg(F.min_by(v, F.struct("quote_seq", "item_pos")).alias(value_col)))


def price_pivot(items: DataFrame, key: str, domain: Sequence, value_col: str = "unit_price", prefix: str = "") -> DataFrame:
    """Wide matrix: one row per (rfq, item), one column per value of the
    fixed ``domain`` of ``key``, and ``other`` for all else (and NULL), so no
    priced line is lost. Cell: the first price in list order. The column
    list is given, so nothing is computed at planning time; the supplier
    grain is ``price_matrix`` (long)."""
    v, order = F.col(value_col), F.struct("quote_seq", "item_pos")
    known = F.coalesce(F.col(key).isin(list(domain)), F.lit(False))
    cell = lambda hit: F.min_by(F.when(hit, v), F.when(hit, order))
    return (items.filter(v.isNotNull() & F.col("item_name").isNotNull())
            .groupBy("rfq_id", "item_name")
            .agg(*[cell(F.col(key) == x).alias(f"{prefix}{x}") for x in domain],
                 cell(~known).alias(f"{prefix}other")))


COLUMNS_A_BLOCK = 100


def supplier_catalogue(items: DataFrame, columns: int = COLUMNS_A_BLOCK) -> DataFrame:
    """``(rfq_id, supplier_name, block, position)``: the place of each supplier with a price in its RFQ's wide tables, by name."""
    priced = items.filter(F.col("unit_price").isNotNull() & F.col("item_name").isNotNull())
    numbered = positions(priced.select("rfq_id", "supplier_name").distinct(), ["rfq_id"], [F.col("supplier_name")])
    return numbered.select("rfq_id", "supplier_name", F.floor(F.col("position") / columns).cast("int").alias("block"),
                           (F.col("position") % columns).cast("int").alias("position"))


def price_blocks(items: DataFrame, catalogue: DataFrame, columns: int = COLUMNS_A_BLOCK, value_col: str = "unit_price") -> DataFrame:
    """Wide matrix over all suppliers: per (rfq, block, item) one column ``p0`` to
    ``p<columns - 1>`` for each place of the ``supplier_catalogue``; an RFQ with
    more suppliers has more blocks, so every supplier has a column and no row
    grows. Cells are those of ``price_matrix``."""
    cells = price_matrix(items, value_col).join(catalogue.withColumnRenamed("supplier_name", "_s"),
                                                (items["rfq_id"] == catalogue["rfq_id"]) & F.col("supplier_name").eqNullSafe(F.col("_s"))).drop(catalogue["rfq_id"])
    return cells.groupBy("rfq_id", "block", "item_name").agg(
        *[F.max(F.when(F.col("position") == i, F.col(value_col))).alias(f"p{i}") for i in range(columns)])


def cheapest_per_item(items: DataFrame) -> DataFrame:
    """Per (rfq, item): the line with the lowest unit price, first in list
    order on ties; item names compare case-sensitively. One partial
    aggregate of ``min(struct)`` - no window, no sort of a whole group."""
    best = argmin_struct("unit_price", "quote_seq", "item_pos", "supplier_name",
                         "quantity", "total_price").alias("_best")
    return (items.filter(F.col("unit_price").isNotNull() & F.col("item_name").isNotNull())
            .groupBy("rfq_id", "item_name").agg(best)
            .select("rfq_id", "item_name",
                    F.col("_best.supplier_name").alias("best_price_supplier"),
                    F.col("_best.unit_price").alias("best_unit_price"),
                    F.col("_best.quantity").alias("quantity"),
                    F.col("_best.total_price").alias("total_price")))
