import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import line_dedup as L


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9), st.integers(0, 3))
def test_within(a, b, k):
    assert L.within(a, b, k) == (edit(a, b) <= k)


def mutated(r, x, n):
    for _ in range(n):
        p = r.randrange(len(x))
        x = r.choice([x[:p] + x[p + 1:], x[:p] + r.choice("abé") + x[p:], x[:p] + r.choice("abé") + x[p + 1:]])
    return x


def test_close_lines_share_a_name():
    r = random.Random(5)
    for _ in range(400):
        x = "".join(r.choice("abé") for _ in range(r.randint(22, 60)))
        y = mutated(r, x, r.randint(0, 2))
        if len(y) < 20 or edit(x, y) > 2:
            continue
        a, b = (x, y) if len(x) >= len(y) else (y, x)
        name, line, role = L.line_names([a, b], 2, 20)
        own = set(name[(line == 1) & (role >= 4)])
        assert own & set(name[line == 0])
        assert L.first_shared(a, b, 2) >= 0


def slow(docs, edits=2, per=20):
    lines = [(i, n, x.strip(" ")) for i, t in sorted(docs, key=lambda d: d[0]) for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    kinds = sorted({x for _, _, x in lines})
    up = {x: x for x in kinds}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = dict.fromkeys(kinds, 0)
    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            most = min(edits, min(len(x), len(y)) // per)
            if abs(len(x) - len(y)) <= most and edit(x, y) <= most:
                links[x] += 1
                links[y] += 1
                up[root(x)] = root(y)
    seen, out = set(), {i: [0, 0, [], 0] for i, _ in docs}
    for i, n, x in lines:
        out[i][0] += 1
        out[i][3] += links[x]
        if root(x) in seen:
            out[i][1] += 1
            out[i][2].append(n)
        seen.add(root(x))
    return {i: (a, b, c, d) for i, (a, b, c, d) in out.items()}


def corpus(seed=3, n=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 70))).strip() or "x" for _ in range(40)]
    docs = [(i, "\n".join(mutated(r, r.choice(base), r.randint(0, 3)) if r.random() < .8 else "" for _ in range(r.randint(0, 8)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "  \n\n"), (n + 3, docs[1][1])]


def test_operator_equals_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(t, i, "c") for i, t in docs], "text string, doc_id long, key string").repartition(4)
    want = slow(docs)
    assert sum(x[1] for x in want.values()) > 30 and sum(x[3] for x in want.values()) > 30
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed), r.n_links) for r in L.line_report(df).collect()}
    assert got == want
    small = L.linked_lines
    monkeypatch.setattr(L, "linked_lines", lambda rows, **o: small(rows, group_rows=3, block_chars=300, **o))
    assert {r.doc_id: (r.n_lines, r.n_removed, list(r.removed), r.n_links) for r in L.line_report(df).collect()} == want
    kept = {r.doc_id: r.text for r in L.without_repeated_lines(df).collect()}
    for i, t in docs:
        gone = set(want[i][2])
        assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert L.without_repeated_lines(df).columns == df.columns


def test_equal_rows_null_ids_and_empty(spark):
    t = "a line that is long enough to count\nshort"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_removed) for r in L.line_report(df).collect())
    assert got == [(-1, 1, 0), (1, 2, 1), (1, 2, 1), (2, 2, 2)]
    assert L.line_report(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    """Only lines of close lengths can link, so the slow way looks at these alone."""
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kinds = sorted({x.strip(" ") for _, t in docs for x in (t or "").split("\n") if x.strip(" ")}, key=len)
    up, links = {x: x for x in kinds}, dict.fromkeys(kinds, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    grams = {x: np.bincount(np.frombuffer(x.encode(), dtype=np.uint8), minlength=256) for x in kinds}
    for a, x in enumerate(kinds):
        for y in kinds[a + 1:]:
            most = min(2, len(x) // 20)
            if len(y) - len(x) > most:
                break
            if np.abs(grams[x] - grams[y]).sum() <= 8 * most and edit(x, y) <= most:
                links[x] += 1
                links[y] += 1
                up[root(x)] = root(y)
    seen, want = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        gone, n, own = [], 0, 0
        for k, x in enumerate((t or "").split("\n")):
            x = x.strip(" ")
            if x:
                n, own = n + 1, own + links[x]
                if root(x) in seen:
                    gone.append(k)
                seen.add(root(x))
        want[i] = (n, len(gone), gone, own)
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed), r.n_links) for r in QUERIES["op2_line_dedup"](spark, sf).collect()}
    assert got == want
