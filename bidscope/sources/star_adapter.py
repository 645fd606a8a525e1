"""Star schema -> quotation tables (the input model of the analytics).

The driver's tables hold no quotations, so this adapter derives them:
one RFQ per part brand, one quotation per (brand, supplier) that sold a part
of that brand, one quote line per lineitem. Every column is a plain
projection of a scan plus two equi-joins to dimension tables; Catalyst picks
the join strategy from sizes (broadcast when the dimension is measured small,
sort-merge otherwise) and pushes the column lists into the parquet scans.

List order (``quote_seq``, ``item_pos``) is carried as explicit keys:
``quote_seq`` = supplier key, ``item_pos`` = ``l_orderkey * 8 + l_linenumber``
(line numbers are 1..7), so no window over a whole quotation is needed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table
from .adapter_store import quote_items_table, quote_pairs_table


def quote_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                    "l_returnflag", "l_linestatus")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(sup, li.l_suppkey == sup.s_suppkey))
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return j.select(
        F.col("p_brand").alias("rfq_id"),
        F.col("s_suppkey").alias("quote_seq"),
        F.col("s_name").alias("supplier_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_pos"),
        F.col("p_name").alias("item_name"),
        F.col("l_quantity").alias("quantity"),
        F.lit("pcs").alias("unit"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), None)
         .otherwise(price.cast("double")).alias("unit_price"),
        # seventh lines carry parts of a cent, which totals must keep
        F.when(F.col("l_returnflag") == "A", None)
         .when(F.col("l_linenumber") == 7, F.col("l_extendedprice") + F.lit(0.004).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("total_price"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("p_type")).alias("portion"),
        F.when(F.col("l_discount") == 0, None)
         .otherwise(F.concat(F.lit("Box of "), F.col("p_size").cast("string"))).alias("packaging"),
    )


def _supplier_terms(sup: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    pay = (F.when(k % 4 == 0, F.concat((F.lit(10) + (k % 5) * 10).cast("string"),
                                       F.lit("% advance, balance on delivery")))
            .when(k % 4 == 1, F.lit("Net 30"))
            .when(k % 4 == 3, F.lit("100% Upfront")))
    return sup.select(
        k.alias("quote_seq"),
        F.when(k % 5 == 0, None).otherwise(F.lit("FOB")).alias("delivery_terms"),
        pay.alias("payment_terms"),
        F.when(k % 3 == 0, None).otherwise(F.lit("6 months")).alias("warranty"),
        F.col("s_nationkey").cast("int").alias("delivery_lead_time_days"),
    )


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (brand, supplier) pair that has lines.

    The pair set is the one stored with the quote lines.
    """
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    pairs = quote_pairs_table(spark, sf_dir, quote_items_view)
    return (pairs.join(_supplier_terms(sup), "quote_seq")
            .select("rfq_id", "quote_seq", "supplier_name", "delivery_terms",
                    "delivery_lead_time_days", "payment_terms", "warranty"))


def rfq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", "p_brand", "p_name")
    return part.select(F.col("p_brand").alias("rfq_id"), F.col("p_name").alias("item_name")).distinct()


def rfqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RFQ per brand. Deadline: brand number n -> 2026-MM-DD with
    MM = n % 12 + 1 and DD = n % 28 + 1; brands divisible by 5 have none."""
    part = read_table(spark, sf_dir, "part", "p_brand")
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    deadline = F.when(n % 5 == 0, None).otherwise(
        F.concat(F.lit("2026-"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("-"),
                 F.lpad((n % 28 + 1).cast("string"), 2, "0")))
    return (part.select("p_brand").distinct()
            .select(F.col("p_brand").alias("rfq_id"),
                    F.concat(F.lit("RFQ-"), F.regexp_replace("p_brand", "#", "-")).alias("rfq_ref"),
                    deadline.alias("deadline_date")))


def quote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote lines of ``sf_dir``: a stored table built once per input
    (see ``adapter_store``)."""
    return quote_items_table(spark, sf_dir, quote_items_view)
