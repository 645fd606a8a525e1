"""Incremental index and record appends as streaming queries."""
from pyspark.sql import functions as F

from bidscope.operators.chunking import chunk_recursive
from bidscope.operators.index_store import add_documents, load_index
from bidscope.operators.retrieve import embed_texts
from bidscope.streaming.incremental import DOC_SCHEMA, index_stream, records_stream


def _docs(spark, ids):
    return spark.createDataFrame([(i, f"text of document {i} " * (50 + i), f"s{i}", "pdf", None)
                                  for i in ids], DOC_SCHEMA)


def test_index_stream_appends_exactly_once(spark, tmp_path):
    land, idx, ck = str(tmp_path / "land"), str(tmp_path / "index"), str(tmp_path / "ck")
    embed = embed_texts(chunk_recursive(_docs(spark, range(10))), "text", 64)
    _docs(spark, range(0, 3)).write.mode("append").parquet(land)
    index_stream(spark, land, idx, ck, embed).awaitTermination()
    n1 = spark.read.parquet(idx).count()
    _docs(spark, range(3, 5)).write.mode("append").parquet(land)
    index_stream(spark, land, idx, ck, embed).awaitTermination()
    got = spark.read.parquet(idx)
    want = chunk_recursive(_docs(spark, range(5))).count()
    assert n1 < got.count() == want
    assert got.select("doc_id").distinct().count() == 5
    assert "embedding" in got.columns
    # a batch append goes to the same table
    index = add_documents(_docs(spark, [77]), embed, idx)
    assert index.select("doc_id").distinct().count() == 6 and index.filter("chunk_id IS NULL").count() == 0
    assert load_index(spark, idx).count() == want + chunk_recursive(_docs(spark, [77])).count()


def test_records_stream(spark, tmp_path):
    land, store, ck = str(tmp_path / "land"), str(tmp_path / "store"), str(tmp_path / "ck")
    schema = "record_type string, raw_text string"
    spark.createDataFrame([("rfq", "a"), ("quotation", "b")], schema).write.parquet(land)
    records_stream(spark, land, store, ck, schema).awaitTermination()
    df = spark.read.parquet(store)
    assert df.count() == 2 and df.filter(F.col("id").isNull()).count() == 0
