"""The demo RFQ and three quotations, from files to recommendation."""
import pytest
from pyspark.sql import functions as F

from bidscope.operators import compare, extract, gaps, outlay, records, recommend
from bidscope.sources import ingest
from tests.demo_files import C_LINES, write_demo

A, B, C = "Bharat Packaging Solutions Pvt Ltd", "Northline Industrial Supplies", "Swift Trade Corp"


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    """Files -> decoded tables -> extracted records -> record store -> read back."""
    folder = str(tmp_path_factory.mktemp("uploads"))
    write_demo(folder)
    store = str(tmp_path_factory.mktemp("store"))
    files = ingest.land(spark, folder + "/*")
    text, cells, _ = ingest.decode_files(files, store + "/decoded")
    pages = spark.createDataFrame([("mem://Quotation_SwiftTrade.pdf", "Quotation_SwiftTrade.pdf", 0,
                                    "\n".join(C_LINES))],
                                  "doc_id string, name string, page_no int, text string")
    docs = text.unionByName(ingest.assemble_pages(pages))
    recs = extract.extract_records(docs, cells).withColumn("source", F.col("doc_id")).withColumn(
        "record_type", F.when(F.col("doc_id").contains("RFQ_"), "rfq").otherwise("quotation"))
    records.append_records(recs, store + "/records")
    return records.list_records(spark, store + "/records")


def _by_name(df, col="supplier_name"):
    return {r[col]: r for r in df.collect()}


def _tables(spark, recs):
    rfq = recs.filter(F.col("doc_id").contains("RFQ_"))
    rfqs = rfq.select(F.lit("R1").alias("rfq_id"), "rfq_ref", "deadline_date")
    order = F.when(F.col("doc_id").contains("Bharat"), 10).when(F.col("doc_id").contains("Northline"), 20).otherwise(30)
    quotes, unmatched = extract.link_records(recs.filter(~F.col("doc_id").contains("RFQ_")).withColumn("uploaded", order), rfqs, order="uploaded")
    assert unmatched.count() == 0 and {r.quote_seq for r in quotes.collect()} == {0, 1, 2}
    q, qi = extract.quote_tables(quotes)
    rfq_items = extract.explode_items(rfq.withColumn("rfq_id", F.lit("R1")), keys=("rfq_id",))
    return rfqs, rfq_items, q, qi


def test_extracted_rfq(demo):
    r = demo.filter(F.col("doc_id").contains("RFQ_")).collect()[0]
    assert r.rfq_ref == "RFQ-2026-014"
    assert r.deadline_date == "2026-09-15"
    assert r.currency == "INR"
    assert r.payment_terms == "30% advance, balance on delivery"
    assert [i.item_name for i in r["items"]] == ["Corrugated Packaging Box (L)", "Steel Rod 12mm",
                                                 "Industrial Sealant Tube", "Pallet Wrap Film"]


def test_extracted_quotations(demo):
    q = _by_name(demo.filter(~F.col("doc_id").contains("RFQ_")))
    assert set(q) == {A, B, C}
    assert q[A].delivery_lead_time_days == 18 and q[B].delivery_lead_time_days == 25
    assert q[C].delivery_lead_time_days == 15
    assert q[A].currency is None and q[B].currency is None and q[C].currency == "INR"
    assert [i.unit_price for i in q[B]["items"]] == [17.9, 59.5, 395.0]
    assert [i.total_price for i in q[A]["items"]] == [92500.0, 124000.0, 116000.0, 123000.0]
    c_items = q[C]["items"]
    assert [i.unit_price for i in c_items] == [19.2, 61.0, 139.0, 405.0]
    assert c_items[0].portion == "Single unit box" and c_items[0].packaging == "Bundle of 50"
    assert c_items[0].unit == "pcs" and c_items[0].total_price is None


def test_totals_rank_savings(spark, demo):
    _, _, _, qi = _tables(spark, demo)
    t = _by_name(compare.total_cost_summary(compare.item_comparison(qi)))
    assert (t[B].total_quoted_cost, t[B].savings_vs_cheapest, t[B]["rank"]) == (327000.0, 0.0, 1)
    assert (t[C].total_quoted_cost, t[C].savings_vs_cheapest, t[C]["rank"]) == (450700.0, 123700.0, 2)
    assert (t[A].total_quoted_cost, t[A].savings_vs_cheapest, t[A]["rank"]) == (455500.0, 128500.0, 3)


def test_cheapest_and_pivot(spark, demo):
    _, _, _, qi = _tables(spark, demo)
    items = compare.item_comparison(qi)
    ch = {r.item_name: r for r in compare.cheapest_per_item(items).collect()}
    assert (ch["Corrugated Packaging Box (L)"].best_price_supplier, ch["Corrugated Packaging Box (L)"].best_unit_price,
            ch["Corrugated Packaging Box (L)"].total_price) == (B, 17.9, 89500.0)
    assert (ch["Industrial Sealant Tube"].best_price_supplier, ch["Industrial Sealant Tube"].total_price) == (C, 111200.0)
    assert ch["Pallet Wrap Film"].best_price_supplier == B and ch["Steel Rod 12mm"].best_unit_price == 59.5
    pv = {r.item_name: r for r in compare.price_pivot(items, "supplier_name", [A, B]).collect()}
    assert len(pv) == 4 and pv["Industrial Sealant Tube"][B] is None
    assert pv["Steel Rod 12mm"][A] == 62.0 and pv["Steel Rod 12mm"].other == 61.0
    # no priced line is lost: every cell of the long matrix is in a column
    assert compare.price_matrix(items).count() == sum(x is not None for r in pv.values() for x in (r[A], r[B], r.other))


def test_gaps_outlay_recommendation(spark, demo):
    rfqs, rfq_items, q, qi = _tables(spark, demo)
    g = gaps.gap_analysis(rfqs, rfq_items, q, qi)
    gb = _by_name(g)
    assert gb[B].missing_items == "industrial sealant tube" and gb[B].gap_score == 3.0
    assert gb[A].gap_score == 0.0 and gb[C].gap_score == 0.0
    assert all(r.rfq_deadline == "2026-09-15" and r.missing_fields == "None" for r in gb.values())
    totals = compare.total_cost_summary(compare.item_comparison(qi))
    o = _by_name(outlay.cash_outlay(q, totals))
    assert (o[B].advance_payment_pct, o[B].upfront_cash_required, o[B].balance_on_delivery) == (50.0, 163500.0, 163500.0)
    assert (o[C].upfront_cash_required, o[C].balance_on_delivery, o[C].delivery_lead_time_days) == (90140.0, 360560.0, 15)
    assert (o[A].upfront_cash_required, o[A].balance_on_delivery) == (136650.0, 318850.0)
    rec = recommend.recommendation(totals, g)
    r = _by_name(rec)
    assert r[B].composite_score == 0.4 and r[A].composite_score == 0.6
    assert r[C].composite_score == 0.577588
    assert recommend.best_supplier(rec).collect()[0].supplier_name == B
