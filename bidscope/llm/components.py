"""Connected components of a links table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links(a, b)``.

    Each step is two aggregates; its links are written to the shared folder,
    so the plan does not grow and a lost executor costs one step. Ends when a
    step changes no link. A large-star step links a node's larger neighbours
    to its smallest one, a small-star step does so for the smaller ones, so no
    list of neighbours is ever gathered.
    """
    now = stored(_clean(links), "cc")
    state = None
    while True:
        step = stored(_star(_star(now, large=True), large=False), "cc")
        # a step that changes nothing keeps count, sum and xor of the hashed links
        new = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop(now)
        now = step
        if new == state:
            break
        state = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _clean(links: DataFrame) -> DataFrame:
    """Links as (larger, smaller), each once."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """New links (larger, smaller) to the smallest of each node and its neighbours."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()
