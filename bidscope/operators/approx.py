"""Approximate top-k over random-projection buckets; exact distances within them.

``build_buckets`` projects every vector on a few random orthogonal directions
and cuts each at its median, so a vector's side of all cuts is its bucket (as
many directions as give about ``rows_a_bucket`` vectors a bucket). Vectors are
stored as blocks by bucket; a bucket with many vectors, copies of one vector
say, is dealt to several blocks.

``approx_topk`` sends a query to its few nearest buckets first; the k-th
distance found there bounds the true one. Then it goes to all buckets whose
cuts lie near: the squared distances from the query to the cuts in between sum
up to at most ``reach`` times that bound. In a bucket all distances are exact;
the k best of all its buckets are the hits. A query whose first buckets hold
fewer than k vectors goes the exact way (``retrieve.similarity_topk``).

With up to as many cuts as dimensions, a reach of 1 would miss nothing: what
lies beyond the cuts is at least that far away. A smaller reach is fitted at
the build: for ``sample`` vectors (the first by a hash of their id, a
documented bound) the exact neighbours are found, and the reach is the
smallest that meets the share ``recall`` of them. As it is a share of the
query's own distances, it also serves queries far from the vectors.
``measured_recall`` compares any result with the exact one.
"""
from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, ship_package
from .retrieve import CORPUS_BLOCK, DEFAULT_K, QUERY_BLOCK, _score_pairs, similarity_topk

ROWS_A_BUCKET, SAMPLE, RECALL, FIRST = 1024, 64, 0.95, 4


def directions(dims: int, n: int, seed: int) -> np.ndarray:
    """``n`` random directions, orthogonal within each run of ``dims``."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(dims, dims)))[0].T for _ in range(-(-n // dims))]
    return np.concatenate(sets)[:n] if sets else np.zeros((0, dims))


def projected(df: DataFrame, vec: str, along: np.ndarray) -> DataFrame:
    """``df`` with ``sides array<double>``: the vector's place along each direction."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["sides"] = list(np.array(b[vec].tolist(), dtype=np.float64).reshape(len(b), -1) @ along.T)
                yield b

    return df.mapInPandas(run, StructType([*df.schema, StructField("sides", ArrayType(DoubleType()))]))


def near_buckets(sides: np.ndarray, cuts: np.ndarray, radius: float = math.inf) -> Iterator[int]:
    """Buckets within ``radius``, nearest first: sets of crossed cuts by the sum of their squared distances."""
    own = sum(1 << int(i) for i in np.flatnonzero(sides > cuts))
    cost = ((sides - cuts) ** 2).tolist()
    order = sorted(range(len(cost)), key=cost.__getitem__)
    held = [(0.0, 0, own)]
    while held:
        total, start, bucket = heapq.heappop(held)
        yield bucket
        for j in range(start, len(order)):
            more = total + cost[order[j]]
            if more > radius:
                break
            heapq.heappush(held, (more, j + 1, bucket ^ (1 << order[j])))


def _blocks(size: int, n_ids: int):
    """mapInPandas body over rows sorted by bucket: blocks of at most ``size`` vectors of one bucket."""
    def block(bucket, rows):
        return (bucket, np.array([r[:n_ids] for r in rows], dtype="<i8").tobytes(), np.array([r[n_ids] for r in rows], dtype="<f8").tobytes(), len(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for b in batches:
            out = []
            for bucket, *row in b.itertuples(index=False, name=None):
                if held and (bucket != at or len(held) >= size):
                    out.append(block(at, held))
                    held = []
                at = bucket
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=["bucket", "ids", "vectors", "n"])
        if held:
            yield pd.DataFrame([block(at, held)], columns=["bucket", "ids", "vectors", "n"])
    return run


_BLOCK = "bucket long, ids binary, vectors binary, n int"


class Buckets:
    """A stored index: its blocks, cuts and reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        made = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
        self.ids, self.rows, self.reach = made["ids"], made["rows"], made["reach"]
        self.cuts = np.array(made["cuts"])
        self.along = directions(made["dims"], len(self.cuts), made["seed"])

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")


def _sides_of(cuts: np.ndarray):
    """The bucket of a row as a column over ``sides``."""
    bits = [F.when(F.get("sides", F.lit(i)) > float(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cuts)]
    total = F.lit(0).cast("long")
    for b in bits:
        total = total + b
    return total


def build_buckets(corpus: DataFrame, path: str, ids: str | Sequence[str] = "id", vec: str = "embedding", *, k: int = DEFAULT_K,
                  rows_a_bucket: int = ROWS_A_BUCKET, recall: float = RECALL, sample: int = SAMPLE, seed: int = 7) -> Buckets:
    """Index ``corpus`` below ``path``; rows without a vector take no part, all others must have one length."""
    spark = corpus.sparkSession
    ship_package(spark)
    ids = [ids] if isinstance(ids, str) else list(ids)
    rows = corpus.where(F.col(vec).isNotNull()).select(*[F.col(i).cast("long").alias(i) for i in ids], F.col(vec).cast("array<double>").alias("v"))
    held = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if held["low"] != held["high"]:
        raise ValueError("vectors of one index must have one length")
    dims, bits = held["high"] or 1, 0
    while bits < 60 and held["n"] > rows_a_bucket << bits:
        bits += 1
    along = directions(dims, bits, seed)
    base = scratch(spark, "projected")
    projected(rows, "v", along).write.parquet(base)
    placed = spark.read.parquet(base)
    cuts = np.zeros(0)
    if bits:
        cuts = np.array(list(placed.agg(*[F.percentile_approx(F.get("sides", F.lit(i)), 0.5, 1000).alias(f"c{i}") for i in range(bits)]).first()), dtype=np.float64)
    sided = placed.withColumn("bucket", _sides_of(cuts))
    size = sided.groupBy("bucket").agg(F.count("*").alias("own"))
    part = F.pmod(F.xxhash64(*ids), F.ceil(F.col("own") / CORPUS_BLOCK)).alias("part")
    dealt = sided.join(size, "bucket").select("bucket", *ids, "v", part)
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").drop("part")
    dealt.mapInPandas(_blocks(CORPUS_BLOCK, len(ids)), _BLOCK).write.parquet(f"{path}/blocks")
    model = {"ids": ids, "rows": held["n"], "dims": dims, "seed": seed, "cuts": cuts.tolist(), "reach": _reach(sided, ids, k, cuts, recall, sample)}
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/model")
    return Buckets(spark, path)


def _reach(sided: DataFrame, ids: list[str], k: int, cuts: np.ndarray, recall: float, sample: int) -> float:
    """The smallest share of a neighbour's squared distance that lets ``recall`` of the exact neighbours of ``sample`` vectors be met."""
    if not len(cuts):
        return 0.0
    some = sided.orderBy(F.xxhash64(*ids), *ids).limit(sample).collect()  # at most ``sample`` rows
    spark = sided.sparkSession
    asked = spark.createDataFrame([(n, list(r["v"])) for n, r in enumerate(some)], "query_id long, embedding array<double>")
    near = similarity_topk(asked, sided, k + 1, corpus_id=ids, corpus_vec="v")  # the vector itself is one
    shares = []
    for r in near.join(sided.select(*ids, "sides"), ids).collect():  # at most sample * (k + 1) rows
        asker = some[r["query_id"]]
        if [asker[i] for i in ids] != [r[i] for i in ids]:
            a, b = np.array(asker["sides"]), np.array(r["sides"])
            cost = float((((a - cuts) ** 2)[(a > cuts) != (b > cuts)]).sum())
            shares.append(cost / r["score"] if r["score"] > 0 else 0.0)
    shares.sort()
    return shares[max(0, math.ceil(recall * len(shares)) - 1)] if shares else 1.0


def _asked(q: DataFrame, index: Buckets, first: int | None) -> DataFrame:
    """Query blocks by bucket: of the ``first`` buckets of each query of ``q(query_id, v, bound)``, or of those that its bound leaves."""
    along, cuts, reach = index.along, index.cuts, index.reach

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, v, bound in zip(b["query_id"], b["v"], b["bound"]):
                sides = along @ np.asarray(v, dtype=np.float64)
                near = islice(near_buckets(sides, cuts), first) if first else near_buckets(sides, cuts, reach * bound * (1 + 1e-9) + 1e-12)
                for bucket in near:
                    out.append((bucket, i, v))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["bucket", "query_id", "v"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["bucket", "query_id", "v"])

    asked = q.mapInPandas(probes, "bucket long, query_id long, v array<double>").repartition("bucket", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    return (asked.sortWithinPartitions("bucket").mapInPandas(_blocks(QUERY_BLOCK, 1), _BLOCK)
            .select("bucket", *[F.col(x).alias(f"q_{x}") for x in ("ids", "vectors", "n")]))


def _found(asked: DataFrame, index: Buckets, k: int) -> DataFrame:
    """The k best of each query among its buckets, written once."""
    ids = index.ids
    schema = ", ".join(["query_id long", *[f"{i} long" for i in ids], "score double"])
    pairs = index.blocks().join(asked, "bucket").drop("bucket").mapInArrow(_score_pairs(k, len(ids), ["query_id", *ids, "score"]), schema)
    w = Window.partitionBy("query_id").orderBy("score", *ids)
    path = scratch(index.spark, "approx_hits")
    pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).write.parquet(path)
    return index.spark.read.parquet(path)


def approx_topk(queries: DataFrame, index: Buckets, k: int = DEFAULT_K, query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """``(query_id, <ids>, rank, score)`` like ``similarity_topk``; hits outside of the probed buckets are missed."""
    ship_package(queries.sparkSession)
    ids = index.ids
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("v"))
    near = _found(_asked(q.withColumn("bound", F.lit(0.0)), index, FIRST), index, k)
    bounds = near.groupBy("query_id").agg(F.count("*").alias("c"), F.max("score").alias("bound")).where(F.col("c") >= min(k, index.rows)).select("query_id", "bound")
    more = _found(_asked(q.join(bounds, "query_id"), index, None), index, k)
    both = near.join(bounds.select("query_id"), "query_id", "left_semi").unionByName(more).select("query_id", *ids, "score").distinct()
    w = Window.partitionBy("query_id").orderBy("score", *ids)
    columns = ["query_id", *ids, F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score")]
    hits = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*columns)
    short = q.join(bounds, "query_id", "left_anti")
    if short.isEmpty():
        return hits
    return hits.unionByName(similarity_topk(short, _corpus(index), k, query_vec="v", corpus_id=ids, corpus_vec="v"))


def _corpus(index: Buckets) -> DataFrame:
    """The indexed rows, out of their blocks."""
    ids = index.ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, vectors, n in zip(b["ids"], b["vectors"], b["n"]):
                out = pd.DataFrame(np.frombuffer(own, dtype="<i8").reshape(n, -1), columns=ids)
                out["v"] = list(np.frombuffer(vectors, dtype="<f8").reshape(n, -1))
                yield out
    return index.blocks().select("ids", "vectors", "n").mapInPandas(run, ", ".join([*[f"{i} long" for i in ids], "v array<double>"]))


def measured_recall(found: DataFrame, exact: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per query of ``exact``: ``n_exact`` hits, ``n_common`` with ``found``. A hit as near as an exact one counts (ties)."""
    kth = exact.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.max("score").alias("_kth"))
    hits = found.join(kth, "query_id").where(F.col("score") <= F.col("_kth") + 1e-9).groupBy("query_id").agg(F.count("*").alias("n_common"))
    return kth.join(hits, "query_id", "left").select("query_id", "n_exact", F.coalesce("n_common", F.lit(0)).alias("n_common"))
