"""Registered queries: drafts, labels, prompts, records, index input,
file classification, page assembly, model-output coercion."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafts, extract, records
from ..session import scratch
from ..sources import derived_text as dt
from ..sources import ingest
from ..sources import star_adapter as star
from ..sources.tables import read_table
from ..streaming.incremental import records_stream
from .queries import QUERIES, _gaps, query

def _langs():
    return F.array(F.lit("en"), F.lit("hi"))


@query("gap_email")
def q_gap_email(spark, d):
    g = _gaps(spark, d, with_lists=True)
    r = star.rfqs(spark, d)
    rows = g.join(r, "rfq_id", "left").withColumn("lang", F.explode(_langs()))
    return drafts.gap_email(rows).select("rfq_id", "quote_seq", "lang", "subject", "body", "status")


@query("award_email")
def q_award_email(spark, d):
    best = QUERIES["best_supplier"](spark, d)
    rows = best.join(star.rfqs(spark, d), "rfq_id", "left").withColumn("lang", F.explode(_langs()))
    return drafts.award_email(rows).select("rfq_id", "lang", "supplier_name", "subject", "body",
                                           "status")


@query("localize")
def q_localize(spark, d):
    keys = drafts.UI_KEYS + ["chart_title"]
    docs = read_table(spark, d, "documents", "doc_id", "lang")
    k = F.element_at(F.array(*map(F.lit, keys)), (F.col("doc_id") % len(keys) + 1).cast("int"))
    return drafts.localize(docs.withColumn("key", k)).select("doc_id", "lang", "key", "text")


@query("prompts")
def q_prompts(spark, d):
    """One prompt per consecutive part of a document; the parts make up the text."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return (docs.select("doc_id", F.length("text").alias("n_chars"), F.posexplode(extract.text_parts("text")).alias("part_no", "user_content")))


def _record_batch(spark, d):
    quotes = extract.extract_records(dt.kv_documents(spark, d)).withColumn(
        "record_type", F.lit("quotation"))
    rfq = star.rfqs(spark, d).select(
        F.col("rfq_id").alias("rfq_key"), "rfq_ref", "deadline_date",
        F.lit("rfq").alias("record_type"),
        F.concat_ws("\n", F.concat(F.lit("RFQ Ref: "), "rfq_ref"),
                    F.concat(F.lit("Deadline: "), "deadline_date")).alias("raw_text"))
    return quotes.unionByName(rfq, allowMissingColumns=True)


def _written(spark, d):
    path = scratch(spark, "records")
    records.append_records(_record_batch(spark, d), path)
    return path


@query("records_roundtrip")
def q_records_roundtrip(spark, d):
    path = _written(spark, d)
    return records.list_records(spark, path).select(
        "record_type", "doc_id", "rfq_key", "raw_text", F.length("id").alias("id_chars"),
        F.col("created_at").isNotNull().alias("has_time"))


def _versions(df, column, version, text):
    """Records under stable ids, with a time that grows with ``version``."""
    at = F.to_timestamp(F.lit("2026-01-01 00:00:00")) + F.expr(f"INTERVAL {version} DAYS")
    return df.select(F.concat_ws("-", "record_type", column).alias("id"), at.alias("created_at"), "record_type", text.alias("raw_text"))


@query("records_upsert")
def q_records_upsert(spark, d):
    """One store, four writers: quotations stream in as one version, RFQs are
    appended, a stream and a batch upsert newer and older versions; read back
    whole, each id once with its newest text."""
    path, new = scratch(spark, "records"), F.concat(F.lit("revised: "), "raw_text")
    both = _record_batch(spark, d).select("record_type", F.col("doc_id").cast("string").alias("q"), F.col("rfq_key").alias("r"), "raw_text")
    quotes, rfqs = both.where("record_type = 'quotation'"), both.where("record_type = 'rfq'")
    schema = "id string, created_at timestamp, record_type string, raw_text string"

    def streamed(rows, upsert):
        landing = scratch(spark, "landing")
        rows.write.parquet(landing)
        records_stream(spark, landing, path, scratch(spark, "checkpoint"), schema, upsert=upsert).awaitTermination()

    streamed(_versions(quotes, "q", 1, F.col("raw_text")), upsert=False)
    records.append_records(_versions(rfqs, "r", 1, F.col("raw_text")), path)
    streamed(_versions(rfqs.where("substr(r, -1) in ('1', '3')"), "r", 5, new), upsert=True)
    records.upsert_records(_versions(quotes.where("q % 3 = 0"), "q", 2, new), path)
    records.upsert_records(_versions(quotes.where("q % 3 <> 2"), "q", 0, F.lit("older")), path)
    got = records.list_records(spark, path)
    return got.select("id", "record_type", "raw_text", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("records_by_type")
def q_records_by_type(spark, d):
    path = _written(spark, d)
    q = records.list_records(spark, path, "quotation")
    return q.select("doc_id", "record_type", "supplier_name", "quotation_ref", "rfq_ref",
                    "deadline_date", "delivery_terms", "delivery_lead_time_days", "payment_terms",
                    "warranty", F.length("raw_text").alias("stored_chars"))


@query("union_docs")
def q_union_docs(spark, d):
    rfq = star.rfqs(spark, d).select(
        F.concat(F.col("rfq_id"), F.lit(".xlsx")).alias("source"), F.lit("excel").alias("file_type"),
        F.lit(ingest.RFQ_SUPPLIER_LABEL).alias("supplier_name"),
        F.concat_ws("\n", F.concat(F.lit("RFQ Ref: "), "rfq_ref"),
                    F.concat(F.lit("Deadline: "), "deadline_date")).alias("raw_text"))
    kv = dt.kv_documents(spark, d)
    head = extract.kv_header_fields(kv).select("doc_id", "supplier_name")
    src = F.concat(F.lit("Q_"), F.col("doc_id").cast("string"), F.lit("."), F.col("file_type"))
    q = (kv.join(head, "doc_id", "left")
           .select(src.alias("source"), "file_type",
                   ingest.default_supplier("supplier_name", src).alias("supplier_name"), "raw_text"))
    return rfq.unionByName(q)


# Fixed test values: file suffixes used to name the documents.
SUFFIXES = [".xlsx", ".XLS", ".xlsm", ".pdf", ".PDF", ".docx", ".doc", ".txt", ""]


@query("classify_files")
def q_classify_files(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "source")
    sfx = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    p = docs.select("doc_id", F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                                       sfx).alias("path"))
    return p.select("doc_id", "path", ingest.classify("path").alias("file_type"),
                    ingest.classify("path").isNotNull().alias("supported"),
                    ingest.file_stem("path").alias("supplier_default"))


@query("assemble_pages")
def q_assemble_pages(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    pages = docs.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"),
                                           F.lit(".pdf")).alias("name"),
                        F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return ingest.assemble_pages(pages)


@query("coerce_json")
def q_coerce_json(spark, d):
    p = read_table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    z = F.col("p_size").cast("string")
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    txt = dt.pick(k, 5,
                  F.concat(F.lit('{"supplier_name": '), name, F.lit(', "items": [')),
                  F.concat(F.lit('{"supplier_name": '), name, F.lit(', "quotation_ref": "Q-'),
                           k.cast("string"), F.lit('", "items": [{"item_name": "'), F.col("p_type"),
                           F.lit('", "quantity": '), z, F.lit(', "unit_price": "'),
                           F.floor("p_retailprice").cast("string"), F.lit('.5"}], "extra": true}')),
                  F.concat(F.lit('{"supplier_name": null, "items": "none", "delivery_lead_time_days": '),
                           z, F.lit("}")),
                  F.lit("not json at all"),
                  F.concat(F.lit('{"currency": "INR", "items": [], "warranty": "'), z,
                           F.lit(' months"}')))
    c = extract.coerce_json(p.select(k.alias("doc_id"), txt.alias("text")))
    return c.select("doc_id", "is_valid", "supplier_name", "quotation_ref", "currency", "warranty",
                    "delivery_lead_time_days", F.size("items").alias("n_items"),
                    F.get("items", 0)["item_name"].alias("first_item_name"),
                    F.get("items", 0)["quantity"].alias("first_item_quantity"),
                    "notes", "raw_output")

