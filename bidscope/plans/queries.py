"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the whole given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, gaps, outlay, recommend
from ..session import scratch
from ..sources import star_adapter as star
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def _items(spark, d):
    return compare.item_comparison(star.quote_items(spark, d))


@query("item_comparison")
def q_item_comparison(spark, d):
    return _items(spark, d).select(*compare.ITEM_COLUMNS)


@query("total_cost_rank")
def q_total_cost_rank(spark, d):
    return compare.total_cost_summary(_items(spark, d))


@query("price_matrix")
def q_price_matrix(spark, d):
    return compare.price_matrix(_items(spark, d))


@query("price_pivot")
def q_price_pivot(spark, d):
    """Item x supplier nation (25 nations); the supplier grain is price_matrix."""
    nation = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    items = _items(spark, d).join(nation, F.col("quote_seq") == F.col("s_suppkey"))
    return compare.price_pivot(items, "s_nationkey", range(25), prefix="nation_")


@query("price_blocks")
def q_price_blocks(spark, d):
    """Item x supplier, wide: 32 suppliers a block, with the catalogue's names beside the prices."""
    items, columns = _items(spark, d), 32
    catalogue = compare.supplier_catalogue(items, columns)
    names = catalogue.groupBy("rfq_id", "block").agg(*[F.max(F.when(F.col("position") == i, F.col("supplier_name"))).alias(f"s{i}") for i in range(columns)])
    return compare.price_blocks(items, catalogue, columns).join(names, ["rfq_id", "block"])


@query("cheapest_per_item")
def q_cheapest_per_item(spark, d):
    return compare.cheapest_per_item(_items(spark, d))


def _gaps(spark, d, qi=None, with_lists=False):
    qi = qi if qi is not None else star.quote_items(spark, d)
    return gaps.gap_analysis(star.rfqs(spark, d), star.rfq_items(spark, d),
                             star.quotations(spark, d), qi, with_lists=with_lists)


@query("missing_items")
def q_missing_items(spark, d):
    qi = star.quote_items(spark, d)
    return gaps.missing_items_text(star.rfq_items(spark, d), star.quotations(spark, d), qi)


@query("gap_analysis")
def q_gap_analysis(spark, d):
    return _gaps(spark, d)


@query("cash_outlay")
def q_cash_outlay(spark, d):
    qi = star.quote_items(spark, d)
    return outlay.cash_outlay(star.quotations(spark, d),
                              compare.total_cost_summary(compare.item_comparison(qi)))


@query("recommendation")
def q_recommendation(spark, d):
    qi = star.quote_items(spark, d)
    scores = gaps.gap_scores(star.rfq_items(spark, d), star.quotations(spark, d), qi)
    return recommend.recommendation(compare.total_cost_summary(compare.item_comparison(qi)),
                                    scores)


@query("best_supplier")
def q_best_supplier(spark, d):
    return recommend.best_supplier(q_recommendation(spark, d))


@query("presentation_order")
def q_presentation_order(spark, d):
    """Position of each supplier (quotation) in the three sorted views of an RFQ."""
    path = scratch(spark, "totals")  # totals are read by two views
    QUERIES["total_cost_rank"](spark, d).write.parquet(path)
    totals, qi = spark.read.parquet(path), star.quote_items(spark, d)
    rec = recommend.recommendation(totals, gaps.gap_scores(star.rfq_items(spark, d), star.quotations(spark, d), qi))

    def view(df, *order):  # only the columns of the order are sorted and stored, no texts of lists
        return recommend.with_position(df.select("rfq_id", *order), *order)
    views = (("total", view(totals, "total_quoted_cost", "supplier_name"), None),
             ("gap", view(_gaps(spark, d), "gap_score", "supplier_name", "quote_seq"), "quote_seq"),
             ("composite", view(rec, "composite_score", "supplier_name"), None))
    rows = [v.select(F.lit(k).alias("view"), "rfq_id", "supplier_name", (F.col(q) if q else F.lit(None)).cast("long").alias("quote_seq"), "position") for k, v, q in views]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("gap_list_segments")
def q_gap_list_segments(spark, d):
    """The lists of gap_analysis in segments of at most 50 entries."""
    entries = gaps.gap_entries(star.rfq_items(spark, d), star.quotations(spark, d), star.quote_items(spark, d))
    return gaps.list_segments(entries, 50)


FLAGSHIP = "recommendation"
