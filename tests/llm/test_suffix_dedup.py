import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidscope.llm import suffix_dedup as S


def slow(docs, length):
    """{(id, text): (n_bytes, n_removed, n_spans, sha)} by looking at every string."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - length + 1):
            x = raw[k:k + length]
            if x in seen:
                gone[k:k + length] = True
            seen.add(x)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("v", [1, 7, 13, 73])
def test_cover(v):
    d = S.cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_names_are_equal_for_equal_strings():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 3, S._BLOCK + 5000).astype(np.uint8)
    b[-300:] = b[100:400]
    n = S.names(b, np.arange(len(b) - 99), 100)
    assert n[-1] == n[300] and len(np.unique(n)) >= len(n) - 205


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 700), max_size=20)), max_size=6))
def test_places_round_trip(docs):
    refs = np.array([r for r, _ in docs], dtype=np.int64)
    doc = np.array([k for k, (_, o) in enumerate(docs) for _ in set(o)], dtype=np.int64)
    off = np.array([x for _, o in docs for x in sorted(set(o))], dtype=np.int64)
    r, i, d, o = S.unpack_places(S.pack_places(refs, refs * 2, doc, off))
    assert r[d].tolist() == refs[doc].tolist() and i[d].tolist() == (refs * 2)[doc].tolist() and o.tolist() == off.tolist()


def corpus(seed, n=60):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcd é") for _ in range(r.randint(5, 260))) for _ in range(25)]
    docs = []
    for i in range(n):
        t = "".join(r.choice(parts) if r.random() < .6 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 90))) for _ in range(r.randint(0, 9)))
        docs.append((i, t))
    docs += [(n, docs[3][1]), (n + 1, "z" * 1200), (n + 2, "ab" * 400), (n + 3, None), (n + 4, ""), (n + 5, docs[5][1][7:])]
    return docs


@pytest.mark.parametrize("length,block", [(100, 3000), (100, 1 << 20), (16, 2000)])
@pytest.mark.parametrize("wide", [False, True])
def test_operator_equals_brute_force(spark, length, block, wide):
    docs = corpus(length)
    df = spark.createDataFrame([(t, i, 0) for i, t in docs], "text string, doc_id long, ref int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_strings(df, length=length, block_bytes=block, merge_bytes=block // 2, wide=wide).collect()}
    assert got == slow(docs, length)


def test_equal_rows_and_null_ids(spark):
    t = "some words " * 20
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t[5:])], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.repeated_strings(df).collect())
    alone = slow([(0, t)], 100)[0][1]
    after = slow([(0, t[5:]), (1, t)], 100)
    assert got == [(-1, after[0][1]), (1, after[1][1]), (1, after[1][1]), (2, len(t))]
    assert alone > 0
    assert S.repeated_strings(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_dedup"](spark, sf).collect()}
    assert got == slow(docs, 100)


class Measured(Exception):
    pass


def test_shipped_bytes_do_not_grow_with_the_number_of_buckets(spark, monkeypatch):
    r = random.Random(7)
    docs = [(i, "".join(r.choice("abcdefgh ") for _ in range(6000))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    total = sum(len(t) for _, t in docs)

    def settle(*_):
        def run(batches):
            for b in batches:
                yield pd.DataFrame({"grp": [sum(len(x) + len(y) for x, y in zip(b["keys"], b["places"]))], "places": [b""]})
        return run

    def stored(t, tag):
        raise Measured(t.agg(F.sum("grp")).first()[0])

    monkeypatch.setattr(S, "_settle", settle)
    monkeypatch.setattr(S, "stored", stored)

    def shipped(buckets):
        with pytest.raises(Measured) as e:
            S.repeated_strings(df, bucket_names=total // (8 * buckets))
        return e.value.args[0]

    assert shipped(300) < 1.25 * shipped(5)


def test_only_the_ends_of_repeats_are_named_at_every_start():
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(3000))
    raw = [("".join(r.choice("ijklmnop ") for _ in range(500)) + passage).encode() for _ in range(2)]
    b = S.Texts([0, len(raw[0])], raw)
    n = 100

    def repeated(doc, at, size, all_):
        keys = S.names(b.buffer, at, size)
        _, again, twice = S._first_places(keys)
        return (b.bases[doc] + at - b.first[doc])[twice if all_ else again]

    side = {-73: repeated(*b.sampled(n - 72, 73), n - 72, True)}
    side[73] = repeated(*b.named_at(side, n, 73, False), n + 72, False)
    side[-13] = repeated(*b.named_at(side, n, 13, True), n - 12, True)
    doc, at = b.named_at(side, n, 1, False)
    gone = S.spans_of([(repeated(doc, at, n, False), n), (side[73], n + 72)])
    assert gone == [(4000, 7000)]
    assert len(at) < 2 * 2 * (72 + 12)


def test_equal_ids_and_many_groups(spark):
    docs = [(i // 3, t) for i, (_, t) in enumerate(corpus(11, 90)) if t]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = sum(r.n_removed for r in S.repeated_strings(df, block_bytes=4000, merge_bytes=1500, bucket_names=50).collect())
    order = df.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("ref")).distinct().orderBy("doc_id", "ref").collect()
    alone = slow([(k, r.text) for k, r in enumerate(order)], 100)
    times = {}
    for d in docs:
        times[d] = times.get(d, 0) + 1
    assert got == sum(alone[k][1] * times[(r.doc_id, r.text)] for k, r in enumerate(order))
