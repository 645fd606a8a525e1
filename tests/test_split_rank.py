"""split_rank equals a plain window rank, including hot groups, ties and NULLs."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidscope.operators.hot_window import split_rank


def test_split_rank_matches_window(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 else f"g{i % 17}"      # one group holds two thirds of the rows
        v = None if i % 97 == 0 else float(rnd.randint(0, 400))   # many ties
        rows.append((g, i, v))
    df = spark.createDataFrame(rows, "g string, id int, v double")
    got = split_rank(df, ["g"], "v", "r", splits=8, rows_a_split=3)
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())
    want = df.withColumn("r", F.when(F.col("v").isNotNull(), F.rank().over(w)))
    a = {(r.id, r.r) for r in got.collect()}
    b = {(r.id, r.r) for r in want.collect()}
    assert a == b


def test_tied_value_is_one_row_before_the_window(spark):
    """One value holds most of a group: its rows meet no window, only its count does."""
    df = spark.range(0, 20000).select(F.lit("x").alias("g"), F.when(F.col("id") % 10 < 9, 5.0).otherwise((F.col("id") % 50).cast("double")).alias("v"), "id")
    out = split_rank(df, ["g"], "v", "r", splits=16, rows_a_split=5, extra={"low": F.min("v")})
    w = Window.partitionBy("g").orderBy("v")
    assert sorted(out.select("id", "r").collect()) == sorted(df.select("id", F.rank().over(w).alias("r")).collect())
    assert {r.low for r in out.select("low").distinct().collect()} == {df.agg(F.min("v")).first()[0]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # every window stands on grouped values
    assert "Window" in plan and plan.count("Aggregate") >= 3


def test_splits_follow_the_group(spark):
    rows = [("big", i % 500, i) for i in range(2000)] + [("small", i, i) for i in range(5)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(4)
    for size in (1, 7, 100, 10_000):
        out = split_rank(df, ["g"], "v", "r", rows_a_split=size).collect()
        for g in ("big", "small"):
            values = sorted(v for h, v, _ in rows if h == g)
            assert all(r.r == values.index(r.v) + 1 for r in out if r.g == g)
        assert [r.r for r in out if r.g == "none"] == [None]


def test_parts_of_a_cent_count(spark):
    from bidscope.operators.compare import total_cost_summary
    lines = [("r", "many small", 0.004)] * 1000 + [("r", "one", 3.0), ("r", "none", None), ("q", "half", 0.005), ("q", "tiny", 0.00499999)]
    got = {(r.rfq_id, r.supplier_name): (r.total_quoted_cost, r.rank) for r in total_cost_summary(spark.createDataFrame(lines, "rfq_id string, supplier_name string, total_price double").repartition(3)).collect()}
    assert got == {("r", "many small"): (4.0, 2), ("r", "one"): (3.0, 1), ("r", "none"): (None, None), ("q", "half"): (0.01, 2), ("q", "tiny"): (0.0, 1)}
