import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bidscope.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int"


def words(doc_id, text):
    for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        if h % 199 == 0:
            w = w[:h % len(w)] + w[h % len(w) + 1:]
        yield w


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow(vocab):
    forms, out = {}, []
    by_length = {}
    for w in vocab:
        by_length.setdefault(len(w), []).append(w)
    beside = {w: [u for k in (-1, 0, 1) for u in by_length.get(len(w) + k, []) if near(w, u)] for w in vocab}
    for w, n in vocab.items():
        best = min(beside[w], key=lambda u: (-vocab[u], u), default=None)
        if best is not None and vocab[best] >= 5 * n:
            forms[w] = best
    for w, n in vocab.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(beside[w]), vocab[forms[w]] if w in forms else None))
    return sorted(out)


def vocab_of(rows):
    c = Counter(w for i, t in rows for w in words(i, t))
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


ROWS = [(1, "letter " * 700 + "Letters lettre better " * 20 + "leter lettér " * 6), (2, None), (3, ""), (None, "letter bettér×better÷better " * 5), (4, "a1b2 漢字letter漢字 𠀀lettrr𠀀"),
        (5, "lettrr lettrra " * 5 + "lettrraa " * 1), (5, "lettrraa aaaaaa aaaaaaa aaaaaaaa " * 5), (5, "lettrraa aaaaaa aaaaaaa aaaaaaaa " * 5), (6, ("x" * 70 + " ") * 5 + ("x" * 71 + " ") * 30 + ("y" + "x" * 70 + " ") * 6),
        (7, "ÀBCDEFG Àbcdefg àbcdefg ßbcdefg " * 7), (8, "short ones are not here " * 9), (9, " ".join(["z" * 200_000] * 5)), (10, " ".join(["z" * 199_999 + "y"] * 30))]


@pytest.mark.parametrize("blocks, per_block", [(1 << 20, 16), (1, 1), (2, 64)])
def test_rows_equal_slow_version(spark, monkeypatch, blocks, per_block):
    # one block a pass: many passes; many words a block: many false positives for the exact join
    monkeypatch.setattr(S, "WORDS_A_BLOCK", per_block)
    monkeypatch.setattr(S.near_pairs, "__kwdefaults__", {"blocks_a_pass": blocks})
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(4)
    want = slow(vocab_of(ROWS))
    assert got(S.spelling_variants(df)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) or blocks  # roots beyond the form: see the chain below


def test_chains_ties_and_empty(spark):
    rows = [("chain" + "a" * k, 5 ** (k + 1)) for k in range(1, 9)] + [("tieword", 5), ("tiework", 30), ("tiewors", 30), ("farfromall", 9)]
    df = spark.createDataFrame(rows, "word string, n long")
    res = got(S.variants(df))
    assert res == slow(dict(rows))
    assert dict((r[0], r[2]) for r in res)["chaina"] == "chain" + "a" * 8
    assert dict((r[0], r[1]) for r in res)["tieword"] == "tiework"
    assert S.variants(df.limit(0)).count() == 0
    assert S.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_vocabulary(spark):
    rng = np.random.default_rng(5)
    rows = {"".join(rng.choice(list("abcé漢"), rng.integers(6, 9))): int(n) for n in rng.geometric(0.01, 900)}
    df = spark.createDataFrame(list(rows.items()), "word string, n long").repartition(5)
    assert got(S.variants(df)) == slow(rows)


def test_edit_hashes_equal_hashes_of_edits():
    for w in ("aabbcc", "zéÿàab", "x" * 90 + "q"):
        codes = S._codes([w])
        blocks = S.Blocks({k: 10 for k in range(S.LONG + 1)})
        letters = np.array([ord("b"), ord("z")], dtype=np.uint64)

        def edits(bits):
            found = S.neighbours([w], letters, S.Probe(blocks, 0, blocks.total, bits))
            return [w[:at] + (' bz'[x] if x else "") + w[at + 1:] for _, ats, xs, _ in found for at, x in zip(ats.tolist(), xs.tolist())]
        every = edits(np.full((blocks.total, 8), 0xFFFFFFFF, dtype=np.uint32))
        want = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in "bz" if c > w[i]}
        assert len(every) == len(set(every)) and set(every) == want
        # a filter of these edits alone finds each of them: the hashes agree
        bits = np.zeros((blocks.total, 8), dtype=np.uint32)
        for e in want:
            h = S._mixed((S._codes([e]) * S._powers(len(e))).sum(1, dtype=np.uint64))
            for j in range(8):
                bits[int(blocks.of(min(len(e), S.LONG), h)[0]), j] |= np.uint32(1) << S._bits(h, j)[0]
        assert set(edits(bits)) == want
        assert codes.shape == (1, len(w))


def test_query_equals_slow_version(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    res = got(QUERIES["op13_spelling_variants"](spark, sf))
    assert res == slow(vocab_of(rows)) and len(res) > 100
