import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import packing as P


def placed(h, **options):
    p = P.Plan(dict(h), **options)
    assert not any(p.left.values())
    fill, ranks = {}, {}
    for n, r, c, f, o in p.runs:
        ranks.setdefault(n, []).append((r, c))
        for k in range(c):
            fill.setdefault(f + k, []).append((o, n))
    for n, c in h.items():
        at = 0
        for r, k in sorted(ranks.get(n, [])):
            assert r == at
            at += k
        assert at == c
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= p.seq_len
    assert len(fill) == p.sequences
    return p


def best_fit(h, size):
    gaps, bins = [], 0
    for n in sorted(h, reverse=True):
        for _ in range(h[n]):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                bins, fit = bins + 1, size
            else:
                gaps.remove(fit)
            gaps.append(fit - n)
    return bins


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from([1, 4]))
def test_plans_are_whole_and_tight(h, grain):
    p = placed(h, seq_len=64, grain=grain)
    lower = -(-sum(n * c for n, c in h.items()) // 64)
    assert p.sequences >= lower
    assert p.sequences <= best_fit(h, 64) * 1.12 + 2
    assert p.sequences <= best_fit(h, 64)


def test_patterns_pay_on_given_lengths():
    """Lengths of the kind the given tables hold: as few sequences as the tokens allow, a good part by patterns."""
    rng = np.random.default_rng(8)
    h = {}
    for n in np.minimum(2048, rng.lognormal(6.3, 1.1, 12_000)).astype(int) + 1:
        h[int(min(n, 2048))] = h.get(int(min(n, 2048)), 0) + 1
    p = placed(h)
    assert p.sequences == -(-sum(n * c for n, c in h.items()) // 2048)
    assert p.by_pattern > 0.7 * p.sequences


def test_plan_on_many_lengths():
    rng = np.random.default_rng(3)
    h = {}
    for n in np.minimum(2048, rng.lognormal(6.4, 0.9, 60_000)).astype(int) + 1:
        h[int(min(n, 2048))] = h.get(int(min(n, 2048)), 0) + 1
    p = placed(h)
    assert p.sequences <= -(-sum(n * c for n, c in h.items()) // 2048) * 1.005
    assert p.by_pattern > 0.8 * p.sequences
    assert p.sequences <= best_fit(h, 2048)


def test_nnls_equals_slow_solution():
    rng = np.random.default_rng(0)
    for _ in range(10):
        a, b = rng.random((12, 30)), rng.random(12)
        x = P.nnls(a, b)
        assert (x >= 0).all()
        grad = a.T @ (b - a @ x)  # optimal: no way up, none held down where x > 0
        assert grad.max() < 1e-6 and abs(grad[x > 0]).max(initial=0) < 1e-6


def tokens(t):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.default_vocabulary()["json_path"]).encode(t or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", "a", "Hello  world\n\n x ", " lead", "<|endoftext|> in text", "don't we'LL 1234 é ñ 中文 \x00", "tail \t", "word " * 5000, "x  y z"]


def test_encoder_equals_tokenizers(spark):
    e = P.Encoder(**P.default_vocabulary())
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in TEXTS + docs:
        assert e.ids(t or "") + [0] == tokens(t)


@pytest.mark.parametrize("seq_len", [2048, 100])
def test_pieces_round_trip(spark, seq_len):
    rows = [(i, t, 1, "c") for i, t in enumerate(TEXTS)] + [(2, "a", 1, "c"), (None, "b", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, rank string").repartition(3)
    got = P.pack(df, seq_len=seq_len, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for i, t in enumerate(TEXTS):
        parts = sorted(by[i], key=lambda r: r.piece)
        if i == 2:
            assert [r.ids for r in parts] == [tokens("a")] * 2
            continue
        want = tokens(t)
        assert [x for r in parts for x in r.ids] == want
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1]) and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == seq_len for r in parts[1:]) and (len(parts) == 1) == (len(want) <= seq_len)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= seq_len
    assert P.pack(df.limit(0)).count() == 0


def test_query_places_every_token_once(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_pattern_packing"](spark, sf).collect()
    want = {i: tokens(t) for i, t in texts.items()}
    fill = {}
    for r in got:
        part = np.array(want[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    h = {}
    for r in got:
        h[r.length] = h.get(r.length, 0) + 1
    assert len(fill) <= best_fit(h, 2048)
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
