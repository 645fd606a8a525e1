import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bidscope.llm import language_id as L

SCHEMA = "doc_id long, lang string, text string, score string, gram int"


def grams(text):
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
        return Counter()
    out = Counter()
    for w in words:
        out.update(w)
    line = " " + " ".join(words) + " "
    out.update(line[i:i + 2] for i in range(len(line) - 1))
    out.update(t for i in range(len(line) - 2) if (t := line[i:i + 3])[1] != " ")
    return out


def top(counts, size):
    # n-grams of one length compare by code points, shorter ones come first
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def slow(rows, size):
    sums = defaultdict(Counter)
    for i, lang, text in rows:
        if lang is not None and not out(i) and grams(text):
            sums[lang].update(grams(text))
    known = {k: {g: n for n, g in enumerate(top(c, size))} for k, c in sums.items()}
    res = []
    for i, _, text in rows:
        own = top(grams(text), size)
        if not own or not known:
            res.append((i, out(i), "und", 0.0))
            continue
        far = size * len(own)
        d = sorted((sum(abs(n - p[g]) if g in p else size for n, g in enumerate(own)), k.encode(), k) for k, p in known.items())
        after = d[1][0] if len(d) > 1 else far
        res.append((i, out(i), d[0][2], (after - d[0][0]) / after if after else 0.0))
    return sorted(res, key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in df.collect()), key=str)


ROWS = [(i, ["en", "de", "fr", None][i % 4], f"{['the other thing', 'der andere Weg', 'les autres été', 'x'][i % 4]} {i} " * (i % 5)) for i in range(30)]
ROWS += [(31, "en", None), (None, "de", "ohne Nummer über"), (32, "", "empty language name"), (33, "el", "Ὀδυσσεύς ΣΟΦΟΣ"), (34, "hi", "हिन्दी भाषा"), (35, "zh", "漢字𠀀𠀁"),
         (36, "en", "12 34 !!"), (37, "en", "́́"), (38, "en", "a\nb\tc  d--e"), (5, "en", "same"), (5, "en", "same"), (39, "en", "the " * 300_000 + "end of a long text")]


@pytest.mark.parametrize("size, a_pass, piece", [(300, 256, 1 << 20), (5, 2, 7), (20, 1, 1000)])
def test_rows_equal_slow_version(spark, monkeypatch, size, a_pass, piece):
    monkeypatch.setattr(L, "_PIECE", piece)
    rows = [r if piece > 999 or r[0] != 39 else (39, "en", "the " * 50) for r in ROWS]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    known = L.profiles(df.where(~L.held_out(F.col("doc_id"))).select("lang", "text"), size)
    res = L.identify(df, known, size=size, a_pass=a_pass).withColumn("held_out", L.held_out(F.col("doc_id")))
    assert got(res) == slow(rows, size)


def test_counts_in_pieces_and_flushed(spark, monkeypatch):
    monkeypatch.setattr(L, "_HELD", 40)
    df = spark.createDataFrame([(*r, "", 0) for r in ROWS[:30]], SCHEMA).coalesce(1)
    known = defaultdict(dict)
    for r in L.profiles(df, 50).collect():
        known[r.lang][r.place] = r.gram
    monkeypatch.undo()
    again = defaultdict(dict)
    for r in L.profiles(df.repartition(5), 50).collect():
        again[r.lang][r.place] = r.gram
    assert known == again and set(known) == {"en", "de", "fr"}


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, None, "some text", "", 0)], SCHEMA)
    assert got(L.predictions(df)) == [(1, out(1), "und", 0.0)]
    assert L.predictions(df.limit(0)).count() == 0


def test_query_on_held_out_rows(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    res = got(QUERIES["op12_language_id"](spark, sf))
    assert res == slow(rows, L.PROFILE)
    want = {i: lang for i, lang, text in rows if grams(text)}
    held = [(p, want[i]) for i, h, p, _ in res if h and i in want]
    assert len(held) > 300 and sum(a == b for a, b in held) >= 0.99 * len(held)
