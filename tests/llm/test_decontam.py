import hashlib
import random
import re

import pytest

from bidscope.llm import decontam as D

W = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow(docs, bench, window=10):
    spans = []
    for item, t in bench:
        w = W.findall(lower(t))
        spans += [(item, w[i:i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for d, t in docs:
        found = list(W.finditer(lower(t)))
        w = [m[0] for m in found]
        hit, items = [False] * len(w), set()
        for item, x in spans:
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit[i:i + len(x)] = [True] * len(x)
                    items |= {str(item)} - {"None"}
        runs = [(found[i].start(), found[next((j for j in range(i, len(w)) if not hit[j]), len(w)) - 1].end()) for i in range(len(w)) if hit[i] and (i == 0 or not hit[i - 1])]
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), sum(hit), len(items), sha, any(hit), runs))
    return sorted(out, key=str)


def corpus():
    r = random.Random(2)
    word = lambda: r.choice(["a", "Bé", "c3", "ño", "x", "yy", "Z"])
    bench = [(i, " ".join(word() for _ in range(r.randint(1, 16)))) for i in range(12)]
    bench += [(50, None), (51, " .. "), (52, "one ONE"), (None, "null item words"), (9, bench[3][1])]
    docs = [(i, "".join(r.choice([word() + r.choice([" ", "  ", "\n", ", "]), r.choice(bench)[1] or "", " "]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "--"), (5, docs[5][1]), (None, "Null Item; words!"), (103, "one\none one")], bench


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
@pytest.mark.parametrize("window", [10, 4])
def test_equals_brute_force(spark, block_bytes, window):
    docs, bench = corpus()
    d = spark.createDataFrame([(t, i, "clash") for i, t in docs], "text string, doc_id long, n_hit string").repartition(3)
    b = spark.createDataFrame([(i, t) for i, t in bench], "item_id long, text string")
    rows = D.digest(D.contamination(d, b, window=window, block_bytes=block_bytes)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, [tuple(s) for s in r.spans]) for r in rows), key=str)
    want = slow(docs, bench, window)
    assert sum(x[5] for x in want) > 5
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert got == want
    kept = D.without_contaminated(d, b, window=window, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) != [] or window == 4
    clean = sorted(str(x[0]) for x in want if not x[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in D.digest(D.contamination(d, b.limit(0))).collect()] == [0]
    assert D.contamination(d.limit(0), b).count() == 0
    assert D.without_contaminated(d, b).count() == 0 and D.without_contaminated(d, b.limit(0)).count() == 1


def test_query_equals_brute_force(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = QUERIES["op7_decontamination"](spark, sf).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)
    index = {}
    for item, t in bench:
        for x in D.item_windows(W.findall(lower(t)), 10):
            index.setdefault(x, set()).add(str(item))
    want = []
    for d, t in docs:
        w = W.findall(lower(t))
        hit, items = set(), set()
        for n in {len(x) for x in index}:
            for i in range(len(w) - n + 1):
                if (own := index.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    items |= own
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str) and any(x[5] for x in want)
