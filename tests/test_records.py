"""Record store round trip, type filter, upsert view and truncate."""
from pyspark.sql import functions as F

from bidscope.operators import records


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([("rfq", "x" * 6000), ("quotation", "q"), (None, "d")],
                               "record_type string, raw_text string")
    records.append_records(df, path)
    allr = records.list_records(spark, path)
    assert allr.count() == 3
    assert {r.record_type for r in allr.collect()} == {"rfq", "quotation", "document"}
    assert records.list_records(spark, path, "rfq").collect()[0].raw_text == "x" * 6000
    assert records.list_records(spark, path, "rfq").collect()[0].raw_preview == "x" * 5000
    assert allr.select("id").distinct().count() == 3
    again = records.list_records(spark, path).withColumn("created_at", F.current_timestamp())
    both = records.list_records(spark, path).unionByName(again)
    assert records.latest_by_id(both).count() == 3
    tie = spark.createDataFrame([("a", t, c) for t, c in [(1, "x"), (1, "y"), (0, "z")]], "id string, created_at int, raw_text string")
    assert len({tuple(records.latest_by_id(tie.repartition(n)).collect()[0]) for n in (1, 2, 3)}) == 1
    records.delete_all_records(spark, path)
    assert records.list_records(spark, path).count() == 0
