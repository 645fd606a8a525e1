"""Compliance gaps of each quotation against its RFQ.

Per quotation: required items not quoted (an output-sensitive set
difference on a normalised name key), missing header fields, items lacking
packaging / portion, the RFQ deadline and a weighted gap score. Joins are on ``rfq_id`` (+ ``quote_seq``),
aggregates are grouped by quotation; nothing is windowed over a whole RFQ.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_falsy_num, is_falsy_str, or_default, strip
from .compare import UNKNOWN_SUPPLIER
from .hot_window import positions
from ..session import scratch

# Header fields checked for presence, with their labels, in
# output order.
REQUIRED_FIELDS = [
    ("delivery_terms", "Delivery terms"),
    ("payment_terms", "Payment terms"),
    ("warranty", "Warranty"),
    ("delivery_lead_time_days", "Delivery lead time"),
]
NUMERIC_FIELDS = {"delivery_lead_time_days"}

# Required item keys are compared in hashed blocks of about this many.
MISSING_BLOCK = 4096

# Fixed weights of the gap score.
W_MISSING_ITEM, W_MISSING_FIELD, W_NO_PACKAGING, W_NO_PORTION = 3.0, 1.0, 0.5, 0.5


def item_key(c="item_name"):
    """Case- and space-insensitive item key used for RFQ compliance."""
    return F.lower(strip(c))


def _named(df: DataFrame) -> DataFrame:
    return df.filter(~is_falsy_str("item_name"))


def _required(rfq_items: DataFrame) -> DataFrame:
    """Distinct named required item keys per RFQ."""
    return _named(rfq_items).select("rfq_id", item_key().alias("k")).distinct()


def _quoted(quote_items: DataFrame) -> DataFrame:
    """Distinct named item keys per quotation (a partial aggregate)."""
    return _named(quote_items).select("rfq_id", "quote_seq", item_key().alias("k")).distinct()


def _rfq_sizes(req: DataFrame) -> DataFrame:
    return req.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("_n"))


def missing_item_counts(rfq_items: DataFrame, quotations: DataFrame,
                        quote_items: DataFrame) -> DataFrame:
    """Per quotation: number of required keys it does not quote.

    n(required) - n(required keys it quotes): a semi join on (rfq, key) and
    two counts. No quotation x item pairs and no item list is built.
    ``gap_scores`` takes the same count inside its one-pass aggregate.
    """
    req = _required(rfq_items)
    hit = (_quoted(quote_items).join(req, ["rfq_id", "k"], "left_semi")
           .groupBy("rfq_id", "quote_seq").agg(F.count(F.lit(1)).alias("_hit")))
    return (quotations.select("rfq_id", "quote_seq")
            .join(_rfq_sizes(req), "rfq_id", "left")
            .join(hit, ["rfq_id", "quote_seq"], "left")
            .select("rfq_id", "quote_seq",
                    (F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(F.col("_hit"), F.lit(0)))
                    .cast("int").alias("n_missing")))


def _block_rows(rfq_items: DataFrame, quotations: DataFrame, quote_items: DataFrame,
                block: int) -> DataFrame:
    """One row per (quotation, key block of its RFQ) with the block's missing
    keys (possibly empty); a quotation whose RFQ has no required items gets
    one row with an empty array.

    Output-sensitive set difference, without pairing every quotation with
    every required item and without holding an RFQ's item list in one row:

    1. an RFQ with about n distinct keys hashes them into ``ceil(n / block)``
       blocks (about ``block`` keys per row, however large the RFQ), each
       block's key set a partial aggregate;
    2. quoted keys that are required (a semi join on (rfq, key), which also
       bounds every hit set by its block) are collected as a set per
       (quotation, block), a partial aggregate;
    3. every quotation lists its RFQ's blocks and meets each block's keys by
       an equi-join on (rfq, block), keeping ``array_except(keys, hits)``.
    """
    keys = _named(rfq_items).select("rfq_id", item_key().alias("k"))
    # The block count only balances rows (any count gives the same result),
    # so an approximate distinct count (HLL, a partial aggregate) sizes it.
    sizes = keys.groupBy("rfq_id").agg(
        F.ceil(F.approx_count_distinct("k") / block).cast("long").alias("_nblk"))
    blk = F.pmod(F.xxhash64("k"), F.greatest(F.col("_nblk"), F.lit(1)))
    req_blocks = (keys.join(sizes, "rfq_id")
                  .groupBy("rfq_id", blk.alias("_blk")).agg(F.collect_set("k").alias("_keys")))
    hits = (_named(quote_items).select("rfq_id", "quote_seq", item_key().alias("k"))
            .join(keys, ["rfq_id", "k"], "left_semi")
            .join(sizes, "rfq_id")
            .groupBy("rfq_id", "quote_seq", blk.alias("_blk"))
            .agg(F.collect_set("k").alias("_hit")))
    rows = (quotations.select("rfq_id", "quote_seq").join(sizes, "rfq_id", "left")
            .select("rfq_id", "quote_seq",
                    F.explode_outer(F.sequence(F.lit(0).cast("long"),
                                               F.greatest(F.col("_nblk"), F.lit(1)) - 1))
                    .alias("_blk")))
    empty = F.array().cast("array<string>")
    return (rows.join(hits, ["rfq_id", "quote_seq", "_blk"], "left")
            .join(req_blocks, ["rfq_id", "_blk"], "left")
            .select("rfq_id", "quote_seq", "_blk",
                    F.array_except(F.coalesce("_keys", empty), F.coalesce("_hit", empty))
                    .alias("missing")))


def missing_items(rfq_items: DataFrame, quotations: DataFrame, quote_items: DataFrame,
                  block: int = MISSING_BLOCK) -> DataFrame:
    """Long form: one row per (quotation, required item key not quoted)."""
    return _block_rows(rfq_items, quotations, quote_items, block).select(
        "rfq_id", "quote_seq", F.explode("missing").alias("item_key"))


def missing_item_lists(rfq_items: DataFrame, quotations: DataFrame,
                       quote_items: DataFrame, block: int = MISSING_BLOCK) -> DataFrame:
    """Per quotation: sorted array of the required item keys it does not
    quote (empty when none). The array is the quotation's output cell; it is
    assembled per quotation from its blocks, never per RFQ."""
    return (_block_rows(rfq_items, quotations, quote_items, block)
            .groupBy("rfq_id", "quote_seq")
            .agg(F.array_sort(F.flatten(F.collect_list("missing"))).alias("missing_item_list")))


def _joined_or_none(arr):
    return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit("None"))


def missing_fields_array(prefix: str = ""):
    return F.filter(F.array(*[
        F.when((is_falsy_num if f in NUMERIC_FIELDS else is_falsy_str)(F.col(prefix + f)),
               F.lit(label)) for f, label in REQUIRED_FIELDS]), lambda x: x.isNotNull())


def item_flags(quote_items: DataFrame) -> DataFrame:
    """Per quotation: counts of lines lacking packaging / portion (unnamed
    lines included) and the named ones in list order."""
    def flag(col):
        lack = is_falsy_str(col)
        listed = F.when(lack & ~is_falsy_str("item_name"), F.struct("item_pos", "item_name"))
        return (F.count_if(lack), F.array_sort(F.collect_list(listed)))
    np_n, np_l = flag("packaging")
    nq_n, nq_l = flag("portion")
    return quote_items.groupBy("rfq_id", "quote_seq").agg(
        np_n.alias("n_no_packaging"), np_l.alias("_l_pack"),
        nq_n.alias("n_no_portion"), nq_l.alias("_l_port"))


def _score(n_missing, n_fields, n_pack, n_port):
    s = (n_missing * W_MISSING_ITEM + n_fields * W_MISSING_FIELD
         + F.coalesce(n_pack, F.lit(0)) * W_NO_PACKAGING
         + F.coalesce(n_port, F.lit(0)) * W_NO_PORTION)
    return F.round(s.cast("double"), 1)


def gap_scores(rfq_items: DataFrame, quotations: DataFrame,
               quote_items: DataFrame) -> DataFrame:
    """Per quotation: the gap score alone (what the recommendation reads).

    Same score as ``gap_analysis``, from counts only, with one pass over the
    quote lines: a partial aggregate per (quotation, item key) counts lines
    lacking packaging / portion (unnamed lines under a NULL key), a join
    with the distinct required keys marks the keys that count as quoted,
    and a second aggregate per quotation sums both. Missing items are
    n(required) - n(marked keys); no item list is built.
    """
    req = _required(rfq_items)
    lack = lambda c: F.count_if(is_falsy_str(c))
    per_key = (quote_items
               .select("rfq_id", "quote_seq", "packaging", "portion",
                       F.when(~is_falsy_str("item_name"), item_key()).alias("k"))
               .groupBy("rfq_id", "quote_seq", "k")
               .agg(lack("packaging").alias("_np"), lack("portion").alias("_nq")))
    per_q = (per_key.join(req.withColumn("_req", F.lit(1)), ["rfq_id", "k"], "left")
             .groupBy("rfq_id", "quote_seq")
             .agg(F.sum("_np").alias("_np"), F.sum("_nq").alias("_nq"),
                  F.count("_req").alias("_hit")))
    q = quotations.select("rfq_id", "quote_seq",
                          or_default("supplier_name", UNKNOWN_SUPPLIER).alias("supplier_name"),
                          F.size(missing_fields_array()).alias("_nf"))
    j = (q.join(_rfq_sizes(req), "rfq_id", "left")
          .join(per_q, ["rfq_id", "quote_seq"], "left"))
    n_missing = F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(F.col("_hit"), F.lit(0))
    return j.select("rfq_id", "quote_seq", "supplier_name",
                    _score(n_missing, F.col("_nf"), F.col("_np"), F.col("_nq")).alias("gap_score"))


def gap_analysis(rfqs: DataFrame, rfq_items: DataFrame, quotations: DataFrame,
                 quote_items: DataFrame, with_lists: bool = False) -> DataFrame:
    miss = missing_item_lists(rfq_items, quotations, quote_items)
    flags = item_flags(quote_items)
    deadline = rfqs.select("rfq_id", or_default("deadline_date", "Not specified").alias("rfq_deadline"))
    q = quotations.select("rfq_id", "quote_seq",
                          or_default("supplier_name", UNKNOWN_SUPPLIER).alias("supplier_name"),
                          missing_fields_array().alias("missing_field_list"))
    j = (q.join(miss, ["rfq_id", "quote_seq"], "left")
          .join(flags, ["rfq_id", "quote_seq"], "left")
          .join(deadline, "rfq_id", "left"))
    mi = F.coalesce(F.col("missing_item_list"), F.array().cast("array<string>"))
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda s: s["item_name"])
    score = _score(F.size(mi), F.size("missing_field_list"), F.col("n_no_packaging"),
                   F.col("n_no_portion"))
    cols = [
        "rfq_id", "quote_seq", "supplier_name",
        _joined_or_none(mi).alias("missing_items"),
        _joined_or_none(F.col("missing_field_list")).alias("missing_fields"),
        _joined_or_none(names("_l_pack")).alias("items_missing_packaging"),
        _joined_or_none(names("_l_port")).alias("items_missing_portion"),
        F.coalesce(F.col("rfq_deadline"), F.lit("Not specified")).alias("rfq_deadline"),
        score.alias("gap_score"),
    ]
    if with_lists:
        cols += [mi.alias("missing_item_list"), "missing_field_list"]
    return j.select(*cols)


def missing_items_text(rfq_items: DataFrame, quotations: DataFrame,
                       quote_items: DataFrame) -> DataFrame:
    """Per quotation: sorted, comma-joined missing item keys and their count."""
    m = missing_item_lists(rfq_items, quotations, quote_items)
    return m.select("rfq_id", "quote_seq", F.size("missing_item_list").alias("n_missing"),
                    _joined_or_none(F.col("missing_item_list")).alias("missing_items"))


# Entries in one segment of a list; lists of up to so many entries are numbered in one task.
LIST_ENTRIES, WHOLE_ENTRIES = 1000, 100_000


def gap_entries(rfq_items: DataFrame, quotations: DataFrame, quote_items: DataFrame) -> DataFrame:
    """Long form of the three lists of ``gap_analysis``: ``(rfq_id, quote_seq, kind, place, entry)``,
    ordered by place (lines) and entry."""
    def lacking(column, kind):
        rows = quote_items.filter(is_falsy_str(column) & ~is_falsy_str("item_name"))
        return rows.select("rfq_id", "quote_seq", F.lit(kind).alias("kind"), F.col("item_pos").alias("place"), F.col("item_name").alias("entry"))
    missing = missing_items(rfq_items, quotations, quote_items).select(
        "rfq_id", "quote_seq", F.lit("missing_items").alias("kind"), F.lit(0).cast("long").alias("place"), F.col("item_key").alias("entry"))
    return missing.unionByName(lacking("packaging", "items_missing_packaging")).unionByName(lacking("portion", "items_missing_portion"))


def list_segments(entries: DataFrame, entries_a_segment: int = LIST_ENTRIES, whole: int = WHOLE_ENTRIES) -> DataFrame:
    """Each list in numbered segments of a bounded number of entries:
    ``(rfq_id, quote_seq, kind, segment, n_entries, text)``. The texts of a
    list's segments, joined by ", ", are the text of ``gap_analysis``; a
    quotation with millions of lines has more segments, not a larger row.

    Entries are written once and counted. Lists of up to ``whole`` entries
    are numbered by a window and put together in the same stage, after one
    shuffle; only longer ones are placed by ``positions`` over all tasks."""
    groups = ["rfq_id", "quote_seq", "kind"]
    spark, path = entries.sparkSession, scratch(entries.sparkSession, "entries")
    entries.write.parquet(path)
    known = spark.read.schema(entries.schema).parquet(path)
    own = F.array_sort(F.collect_list(F.struct("position", "entry")))

    def put_together(placed):
        return (placed.groupBy(*groups, F.floor(F.col("position") / entries_a_segment).cast("int").alias("segment"))
                .agg(F.count("*").cast("int").alias("n_entries"), F.array_join(F.transform(own, lambda x: x["entry"]), ", ").alias("text")))

    def numbered(rows):
        w = Window.partitionBy(*groups).orderBy("place", "entry")
        return put_together(rows.withColumn("position", F.row_number().over(w) - 1))

    sizes = known.groupBy(*groups).agg(F.count("*").alias("_n"))
    long = sizes.filter(F.col("_n") > whole).select(*[F.col(g).alias(f"_{g}") for g in groups])  # at most rows / whole
    if long.isEmpty():
        return numbered(known)
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
    placed = positions(known.join(long, same, "left_semi"), groups, [F.col("place"), F.col("entry")])
    return numbered(known.join(long, same, "left_anti")).unionByName(put_together(placed))
