"""Registered extraction queries over text derived from the star schema."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aliases import HEADER_FIELD_ALIASES, ITEM_COLUMN_ALIASES, match_alias_table, with_alias_field
from ..functions.terms import advance_pct, clean_number, infer_currency, normalize_date, parse_iso_date
from ..functions.text import normalize_key
from ..operators import extract
from ..sources import derived_text as dt
from ..sources.tables import read_table
from .queries import query


@query("normalize_keys")
def q_normalize_keys(spark, d):
    return dt.header_texts(spark, d).select("p_partkey", "header",
                                            normalize_key("header").alias("header_key"))


@query("alias_match")
def q_alias_match(spark, d):
    h = dt.header_texts(spark, d)
    h = with_alias_field(h, "header", "header_field", HEADER_FIELD_ALIASES)
    h = with_alias_field(h, "header", "item_field", ITEM_COLUMN_ALIASES)
    return h.select("p_partkey", normalize_key("header").alias("header_key"), "header_field",
                    "item_field")


@query("alias_table")
def q_alias_table(spark, d):
    """Texts that begin with a part type, matched to an alias table that grows
    with the parts: every type, and its first word or two, name their maker's
    family; beside it the header texts with the fixed aliases as a table."""
    p = read_table(spark, d, "part", "p_partkey", "p_type", "p_size")
    cut = lambda n: F.substring_index(normalize_key("p_type"), " ", n)
    kinds = p.select("p_type").distinct().select(F.explode(F.array(*[F.struct(cut(n).alias("alias"), F.lit(n).alias("n")) for n in (1, 2, 9)])).alias("x")).select("x.*").distinct()
    table = kinds.select("alias", F.concat_ws("/", F.col("n").cast("string"), "alias").alias("field"), F.concat_ws("/", F.col("n").cast("string"), "alias").alias("field_order"))
    size = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("  Size "), F.col("p_size").cast("string")))
    texts = p.select("p_partkey", F.concat("p_type", size).alias("text"))
    out = match_alias_table(match_alias_table(texts, "text", "family", table), "text", "kind", table, longest_prefix=True)
    fixed = spark.createDataFrame([(a, f, i) for i, (f, al) in enumerate(HEADER_FIELD_ALIASES.items()) for a in al], "alias string, field string, field_order int")
    header = match_alias_table(dt.header_texts(spark, d), "header", "header_field", fixed).select("p_partkey", "header_field")
    return out.join(header, "p_partkey")


@query("clean_numbers")
def q_clean_numbers(spark, d):
    return dt.number_texts(spark, d).select("p_partkey", "raw_value",
                                            clean_number("raw_value").alias("number"))


@query("normalize_dates")
def q_normalize_dates(spark, d):
    t = dt.date_texts(spark, d)
    nd = normalize_date("raw_value")
    return t.select("p_partkey", "raw_value", nd.alias("deadline_date"),
                    parse_iso_date(nd).alias("deadline"),
                    normalize_date("raw_value", iso_first=True).alias("deadline_date_iso_first"))


@query("advance_pct")
def q_advance_pct(spark, d):
    return dt.terms_texts(spark, d).select("p_partkey", "payment_terms",
                                           advance_pct("payment_terms").alias("advance_payment_pct"))


@query("kv_header_fields")
def q_kv_header_fields(spark, d):
    return extract.kv_header_fields(dt.kv_documents(spark, d))


@query("items_from_cells")
def q_items_from_cells(spark, d):
    return extract.table_items(dt.table_cells(spark, d))


@query("line_items_from_text")
def q_line_items_from_text(spark, d):
    return extract.lines_without_tables(extract.line_items(dt.item_lines(spark, d)), extract.table_items(dt.table_cells(spark, d)))


@query("extract_documents")
def q_extract_documents(spark, d):
    """Whole documents: routing, field/value sheets, last value wins, text
    lines only where the tables gave no item."""
    text, cells = dt.whole_documents(spark, d)
    r = extract.extract_records(text, cells)
    return r.select("doc_id", "file_type", "supplier_name", "deadline_date", "warranty", F.size("items").alias("n_items"),
                    F.round(F.aggregate("items", F.lit(0.0), lambda s, x: s + F.coalesce(x["quantity"], F.lit(0.0))), 2).alias("quantity"),
                    F.array_min(F.transform("items", lambda x: x["item_name"])).alias("first_name"))


@query("link_records")
def q_link_records(spark, d):
    """Two quotations per supplier, linked to RFQs by reference, else by
    folder; the unmatched ones have no RFQ. ``last_terms``: of the supplier's
    last quotation in the RFQ."""
    nation = read_table(spark, d, "nation", "n_nationkey")
    k = F.col("n_nationkey")
    rfqs = nation.filter(k % 3 != 2).select(
        k.alias("rfq_id"), F.when(k % 3 == 0, F.concat(F.lit(" rfq-"), k.cast("string"))).alias("rfq_ref"),
        F.when(k % 3 == 1, F.concat(F.lit("in/"), k.cast("string"))).alias("folder"))
    recs = extract.extract_records(dt.versioned_records(spark, d)).select("doc_id", "supplier_name", "rfq_ref", "payment_terms")
    linked, rest = extract.link_records(recs, rfqs, folder=F.concat(F.lit("in/"), F.regexp_extract("rfq_ref", r"(\d+)$", 1)))
    last = linked.groupBy("rfq_id", "supplier_name").agg(F.max_by("payment_terms", "quote_seq").alias("last_terms"))
    linked = linked.join(last, ["rfq_id", "supplier_name"])
    none = F.lit(None).cast("long")
    return linked.select("doc_id", "rfq_id", "quote_seq", "last_terms").unionByName(
        rest.select("doc_id", none.alias("rfq_id"), none.alias("quote_seq"), F.lit(None).cast("string").alias("last_terms")))


@query("infer_currency")
def q_infer_currency(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", infer_currency("text").alias("currency"))
