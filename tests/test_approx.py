"""Approximate top-k: probes, recall, copies of one vector, short queries."""
import itertools

import numpy as np
import pytest

from bidscope.operators import approx as A
from bidscope.operators.retrieve import similarity_topk


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>").repartition(4)


def test_probes_are_all_buckets_within_the_radius():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sides, cuts, radius = rng.normal(size=6), rng.normal(size=6) * 0.3, rng.random() * 3
        got = list(A.near_buckets(sides, cuts, radius))
        own = sum(1 << i for i in range(6) if sides[i] > cuts[i])
        want = {own ^ sum(1 << i for i in s) for k in range(7) for s in itertools.combinations(range(6), k) if ((sides - cuts) ** 2)[list(s)].sum() <= radius}
        assert got[0] == own and len(got) == len(set(got)) and set(got) == want
        far = [((sides - cuts) ** 2)[[i for i in range(6) if (b ^ own) >> i & 1]].sum() for b in A.near_buckets(sides, cuts)]
        assert len(far) == 64 and far == sorted(far)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_fewer_probes(spark, tmp_path, clustered):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 4
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.5 if clustered else rng.normal(size=(3000, 16))
    q = x[::50] + rng.normal(size=(60, 16)) * 0.1
    index = A.build_buckets(frame(spark, x), str(tmp_path / "i"), rows_a_bucket=100)
    assert len(index.cuts) == 5 and index.blocks().agg({"n": "sum"}).first()[0] == 3000
    asked = frame(spark, q, "query_id")
    got = A.approx_topk(asked, A.Buckets(spark, index.path))
    exact = similarity_topk(asked, frame(spark, x), corpus_id=["id"])
    r = A.measured_recall(got, exact, ["id"]).collect()
    assert len(r) == 60 and sum(x.n_common for x in r) >= 0.9 * sum(x.n_exact for x in r)
    # what is found is exact: each hit has its true distance, ranks follow
    for h in got.collect():
        assert abs(((x[h.id] - q[h.query_id]) ** 2).sum() - h.score) < 1e-6
    # queries far from all vectors find their share as well
    away = frame(spark, q * 3, "query_id")
    r = A.measured_recall(A.approx_topk(away, index), similarity_topk(away, frame(spark, x), corpus_id=["id"]), ["id"]).collect()
    assert sum(x.n_common for x in r) >= 0.9 * sum(x.n_exact for x in r)
    kth = [np.sort(((x - v) ** 2).sum(1))[5] for v in q]
    probes = [len(list(A.near_buckets(index.along @ v, index.cuts, index.reach * d))) for v, d in zip(q, kth)]
    assert not clustered or np.mean(probes) < 0.5 * 32


def test_copies_short_buckets_and_nulls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "CORPUS_BLOCK", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((400, 4)), rng.normal(size=(30, 4)) * 9])  # one vector holds nearly all rows
    df = frame(spark, x).unionByName(spark.createDataFrame([(999, None)], "id long, embedding array<double>"))
    index = A.build_buckets(df, str(tmp_path / "i"), rows_a_bucket=10, recall=0.5)
    assert index.blocks().agg({"n": "max"}).first()[0] <= 50
    q = np.concatenate([np.zeros((1, 4)), x[400:410] + 0.01, np.full((1, 4), 1e3)])
    asked = frame(spark, q, "query_id").unionByName(spark.createDataFrame([(77, None)], "query_id long, embedding array<double>"))
    got = A.approx_topk(asked, index, k=6).collect()
    assert {r.query_id for r in got} == set(range(12)) and len(got) == 12 * 6
    assert [r.id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        A.build_buckets(frame(spark, [[1.0], [1.0, 2.0]]), str(tmp_path / "j"))
    few = A.build_buckets(frame(spark, x[:3]), str(tmp_path / "k"))
    assert len(A.approx_topk(asked, few, k=6).where("query_id = 0").collect()) == 3
