import numpy as np
import pytest
from pyspark.sql import functions as F

from bidscope.llm import topk_kd as K


def slow(rows, k, every):
    ok = [(i, [int(np.floor(64.0 * float(v))) for v in x]) for i, x in rows
          if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            hits = sorted((-sum(u * v for u, v in zip(q, x)), j, b) for b, (j, x) in enumerate(ok) if b != a and len(x) == len(q))
            out += [(i, n, j, -s) for n, (s, j, _) in enumerate(hits[:k], 1)]
    return sorted(out)


def vectors(n, d, seed, decimals=None):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return [(i, [float(v) for v in (np.round(r, decimals) if decimals is not None else r)]) for i, r in enumerate(x)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in K.top_k(df.repartition(3), **options).collect())


@pytest.mark.parametrize("n,d,decimals", [(900, 8, None), (500, 3, 0)])  # the second has many ties
@pytest.mark.parametrize("shard_rows,query_rows", [(10_000, 1000), (150, 9)])
def test_equals_brute_force(spark, n, d, decimals, shard_rows, query_rows):
    rows = vectors(n, d, n, decimals)
    assert found(spark, rows, shard_rows=shard_rows, query_rows=query_rows, leaf_rows=20) == slow([(i, np.float32(x).tolist()) for i, x in rows], 20, 20)


def test_odd_rows(spark):
    rows = vectors(50, 4, 1)
    rows += [(100, None), (None, [1.0] * 4), (120, [1.0, None, 2.0, 0.0]), (140, [float("nan")] * 4), (160, [float("inf")] * 4), (180, []),
             (200, [1.0, 2.0]), (220, [2.0, -1.0]), (20, rows[3][1]), (20, rows[3][1])]
    got = found(spark, rows, shard_rows=13)
    assert got == slow([(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows], 20, 20)
    huge = found(spark, rows[50:] + [(260, [3e38, 0.0, 0.0, 0.0]), (280, [4e16, 4e16, 4e16, 4e16]), (300, [4e16, 4e16, 4e16, 4e16])], k=1)
    assert (280, 1, 300, (1 << 63) - 1) in huge and not any(260 in r for r in huge)
    assert found(spark, rows[:1]) == [] and found(spark, []) == []


def test_query_equals_brute_force(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_kd_topk"](spark, sf).collect()) == slow(rows, 20, 20)


def test_tree_boxes_hold_their_points():
    x = np.random.default_rng(0).integers(-5, 5, size=(1000, 6)).astype(float)
    leaves, low, high = K.build_tree(x, 50)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 50
    for own, a, b in zip(leaves, low, high):
        assert (x[own].min(0) == a).all() and (x[own].max(0) == b).all()


def test_clustered_vectors_leave_most_shards_unvisited(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 6
    x = centres[rng.integers(0, 16, 3200)] + rng.normal(size=(3200, 8)) * 0.3
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
    seen = {}
    plain = K.visits

    def counted(asking, shared, sizes):
        out = plain(asking, shared, sizes)
        seen["visits"], seen["queries"], seen["shards"] = out.count(), asking.count(), sizes.agg(F.sum("parts")).first()[0]
        return out
    monkeypatch.setattr(K, "visits", counted)
    assert found(spark, rows, shard_rows=100, query_rows=50, leaf_rows=20) == slow(rows, 20, 20)
    assert seen["shards"] >= 32 and seen["visits"] < 0.5 * seen["queries"] * (seen["shards"] - 1)


def test_every_row_has_a_region_whatever_the_sample(spark, monkeypatch):
    monkeypatch.setattr(K, "SAMPLE", 10)
    monkeypatch.setattr(K, "REGIONS", 4)
    rows = vectors(600, 5, 3, 1) + [(700 + i, [0.5] * 5) for i in range(200)] + [(1000 + i, [float(i)]) for i in range(90)]
    assert found(spark, rows, shard_rows=40, leaf_rows=10) == slow([(i, np.float32(v).tolist()) for i, v in rows], 20, 20)
    tree = K.Splits(np.random.default_rng(0).normal(size=(500, 3)), 7)
    assert tree.regions == 7 and set(tree.of(np.random.default_rng(1).normal(size=(2000, 3)))) == set(range(7))
    assert K.Splits(np.ones((5, 2)), 8).regions == 1 and K.Splits(np.zeros((0, 2)), 8).regions == 1
