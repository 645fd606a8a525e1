import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import simhash


def slow_fingerprint(text, n=3):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, radius=3):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=max(1, n // 12), dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
    return np.unique(out)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b é\xa0 z", max_size=40)))
def test_fingerprint_equals_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(text, block=2) == slow_fingerprint(text)


@pytest.mark.parametrize("n,leaf,shard", [(60, 4, 8), (700, 16, 50), (1500, 384, 200)])
def test_dealt_shards_lose_no_link(n, leaf, shard):
    fps = clustered(n, n)
    want = slow_components([int(x) for x in fps])
    forest = simhash._Forest()
    for half in (0, 1):
        nodes = simhash.upper_tree(fps.copy(), half, shard)
        at, shards, home = simhash.deal(fps, nodes, 3)
        assert sorted(at[home]) == list(range(len(fps)))
        for s in np.unique(shards):
            own = shards == s
            for a, b in simhash.shard_links(fps[at[own & home]], fps[at[own & ~home]], half, 3, leaf):
                forest.join(a, b)
    got = [forest.root(int(x)) for x in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def chained(n, seed, back):
    """Each fingerprint three bits off one of the ``back`` before it, in mixed order."""
    rng = np.random.default_rng(seed)
    fps = [rng.integers(0, 2**63, dtype=np.uint64)]
    while len(fps) < n:
        bits = np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)
        fps.append(fps[rng.integers(max(0, len(fps) - back), len(fps))] ^ np.bitwise_xor.reduce(bits))
    return rng.permutation(np.unique(np.array(fps, dtype=np.uint64)))


@pytest.mark.parametrize("n,back", [(300, 1), (700, 3), (1000, 300)])
def test_one_leaf_loses_no_link(n, back):
    # three chains, so that groups must also stay apart
    fps = np.random.default_rng(n).permutation(np.concatenate([chained(n // 3, n + k, back) for k in range(3)]))
    want = slow_components([int(x) for x in fps])
    assert list(simhash._labels(fps, fps, 3)) == want
    cut = len(fps) * 3 // 4  # the last quarter only visits: its own pairs do not count
    up = list(simhash._labels(fps[:cut], fps, 3))
    assert up[:cut] == list(simhash._labels(fps[:cut], fps, 3, rows=cut))[:cut]
    links = simhash.shard_links(fps, fps[:0], 0, 3, leaf=len(fps))
    forest = simhash._Forest()
    for a, b in links:
        forest.join(a, b)
    got = [forest.root(int(x)) for x in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_equal_halves_still_split():
    fps = np.unique(np.random.default_rng(3).integers(0, 2**32, 900, dtype=np.uint64))  # upper halves are all zero
    nodes = simhash.upper_tree(fps, 1, 50)
    assert len(nodes) > 5
    at, shards, home = simhash.deal(fps, nodes, 3)
    assert np.bincount(shards[home]).max() < 200


def test_query_on_odd_rows(spark):
    texts = [None, "", "  ", "a b", "a b", "The quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again"] + ["x " * 5000] * 3
    rows = [(i, t, i, "c") for i, t in enumerate(texts)] + [(3, "a b", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, shard_rows=2).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [slow_fingerprint(d.text) for d in docs]
    root = slow_components(fps)
    assert got == {d.doc_id: (f"{f:016x}", docs[r].doc_id) for d, f, r in zip(docs, fps, root)}
