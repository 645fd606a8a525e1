import hashlib
import zlib
from collections import defaultdict

import pytest

from bidscope.llm import merkle as M

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, up int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, per node: list of (left, right))."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i // 8 * 8
            steps[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 8])))
        nodes = [H("".join(nodes[a:a + 8])) for a in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], steps


def slow(rows):
    groups = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        own = leaf(*r[:5])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0], own, leaf(*r[:4], low) if hit else own))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {g: climb([x[1] for x in groups[g]]) for g in order}
    out = []
    if order:
        root, over = climb([subs[g][0] for g in order])
    for k, g in enumerate(order):
        for (i, own, other), steps in zip(groups[g], subs[g][1]):
            steps = steps + over[k]
            h = other
            for a, b in steps:
                h = H(a + h + b)
            out.append((i, own, subs[g][0], root, H("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


ROWS = [(i, None if i % 5 == 0 else "s", ["de", "en", None, "", "é", "z\U0001f600"][i % 6], i if i % 4 else None, None if i % 7 == 0 else f"Text Ä {i}" * (i % 3)) for i in range(40)]
ROWS += [(None, "s", "en", 1, "No ID"), (None, None, None, None, None), (3, "s", "solo", 9, "A"), *[(500, "s", "en", 2, "Same row")] * 20, (500, "s", "en", 2, "other Row"),
         (-7, "s", "de", 2, "x" * 1_500_000 + "Ö")]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_rows_equal_slow_version(spark, monkeypatch, levels):
    # small blocks give the exchange many rounds and incomplete subtrees
    monkeypatch.setattr(M, "LEVELS", levels)
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(4)
    assert got(M.verified(df)) == slow(ROWS)


@pytest.mark.parametrize("n", [1, 8, 9, 65, 513, 600])
def test_sizes_around_full_subtrees(spark, monkeypatch, n):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = [(i * 3, "s", "en", i, f"T {i}") for i in range(n)]
    assert got(M.verified(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3))) == slow(rows)


def test_many_groups_and_none(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = [(i, "s", f"g{i % 70}", i, f"T {i}") for i in range(150)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert got(M.verified(df)) == slow(rows)
    assert M.verified(df.limit(0)).count() == 0


def test_query_equals_slow_version(spark):
    from bidscope.llm.queries import QUERIES
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    res = got(QUERIES["op11_merkle_manifest"](spark, SF))
    assert res == slow(rows)
    # a text without capitals passes, any other tampered row fails
    assert 0 < sum(not r[-1] for r in res) <= sum(zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in rows)
