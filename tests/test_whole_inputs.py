"""Derived inputs cover whole tables: every part row becomes a table row,
and every brand gets a table document."""
from pyspark.sql import functions as F

from bidscope.sources import derived_text as dt
from bidscope.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_table_cells_cover_every_part(spark):
    cells = dt.table_cells(spark, SF)
    part = read_table(spark, SF, "part", "p_partkey", "p_brand")
    data_rows = cells.filter("row_no > 0").select("row_no").distinct().count()
    assert data_rows == part.count()
    docs = cells.select("doc_id").distinct().count()
    assert docs == part.select("p_brand").distinct().count()
    # every table has exactly one header row
    heads = cells.filter("row_no = 0").groupBy("doc_id", "table_no").agg(
        F.countDistinct("col_no").alias("n"))
    assert heads.filter("n < 7").count() == 0
