import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidscope.llm import toxicity as X


@pytest.fixture(scope="module")
def model():
    text = ("the idiot was stupid and the loser said trash to a moron while every clown is pathetic and well known words are kept "
            "worthless scum disgusting " * 40)
    counts = np.zeros(X.SYMBOLS**3, dtype=np.int64)
    X.count_trigrams([text], counts)
    at = np.flatnonzero(counts)
    return X.CharModel(at, counts[at])


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiiiiot", "idiot"), ("st*u*p1d", "stupid"),
                                        ("cl0wn", "clown"), ("p4thet1c", "pathetic"), ("$cum", "scum"), ("tra$h", "trash"), ("m o r o n", "moron")])
def test_obfuscated_words_are_restored(model, token, word):
    assert X.decode(token, model) == word
    assert word.encode() in X.Restorer(model).readings(f"some text\nyou {token} there")


@pytest.mark.parametrize("text,found", [("you are a m o r o n", {"a", "moron"}), ("you said a m o r o n was a clown", {"a", "moron"}), ("i d i o t a", {"idiot", "a"}),
                                        ("t h e i d i o t", {"the", "idiot"}), ("1d10t-l0s3r", {"idiot", "loser"}), ("i.d.i.o.t.w.a.s.t.r.a.s.h", {"idiot", "was", "trash"})])
def test_separators_may_end_words(model, text, found):
    assert X.Restorer(model).readings(text) >= {w.encode() for w in found}


def test_plain_text_is_left_alone(model):
    r = X.Restorer(model)
    assert r.readings("Just a plain line, with well known words. And 1234 or 555-6835!") == set()
    assert r.readings("") == set()


def every_reading(token):
    out = [("", 0.0)]
    for options in X.lattice(token):
        out = [(a + b, x + y) for a, x in out for b, y in options]
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab1ll0$.é", min_size=1, max_size=6))
def test_viterbi_equals_all_readings(model, token):
    def cost(word, channel):
        a = b = 0
        for c in [*(int(X._CLASS[x]) for x in word.encode()), 0]:
            channel, a, b = channel + model.of(a, b, c), b, c
        return channel
    best = min(cost(w, c) for w, c in every_reading(token.lower()))
    got = X.decode(token, model)
    assert abs(min(cost(w, c) for w, c in every_reading(token.lower()) if w == got) - best) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é1$.\n!rR", max_size=40))
def test_cheap_search_finds_all(text):
    every = {m[0] for line in text.split("\n") for m in X._ODD.finditer(line)}
    assert every == {m[0] for line in X.suspicious_lines(text) for m in X._ODD.finditer(line)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aR 1$.\né啊", max_size=30))
@example("m 0 r 0 n")
@example("you l 0 s 3 r")
@example("1 d 1 0 t there")
@example("a 1 b")
@example("1 a 2")
@example("é 1 é")
@example("1 é 1")
@example("啊 1 b")
@example("1 𝒶 b")
@example("啊啊啊")
@example("a$")
@example("a%1,")
@example("(a 1 b)")
@example("a" * 50 + "1b")
@example("x\u3000a 1 b\u3000x")
def test_cheap_search_finds_letters_and_digits_set_apart(text):
    every = {m[0] for line in text.split("\n") for m in X._ODD.finditer(line)}
    assert every == {m[0] for line in X.suspicious_lines(text) for m in X._ODD.finditer(line)}


@pytest.mark.parametrize("token,word", [("m 0 r 0 n", "moron"), ("l 0 s 3 r", "loser"), ("1 d 1 0 t", "idiot")])
def test_letters_and_digits_set_apart_are_restored(model, token, word):
    assert word.encode() in X.Restorer(model).readings(token)


@pytest.mark.parametrize("token,word", [("idio7", "idiot"), ("asshol3", "asshole"), ("a$$", "ass"), ("(idio7)", "idiot"), ("l0s3r!", "loser"), ("m o r o n, he", "moron"),
                                        ("st.u.p.i.d" + ".a" * 30, "stupid"), ("i\u200bd\u200bi\u200bo\u200bt\u200b" + "x" * 60, None), ("x" * 45 + "1d10t", None),
                                        (" ".join("worthlessdisgustingscumandtrash"), "disgusting")])
def test_gate_admits_ends_and_long_tokens(model, token, word):
    got = X.Restorer(model).readings(f"you {token}")
    assert word.encode() in got if word else any(b"idiot" in w for w in got)


@pytest.mark.parametrize("token,word", [("iddiot", "idiot"), ("mooron", "moron"), ("sccum", "scum"), ("ééclown", "éclown"), ("啊啊b", "啊b")])
def test_gate_admits_doubled_letters(model, token, word):
    assert word.encode() in X.Restorer(model, True).readings(f"you {token} well")
    assert word.encode() in X.Restorer(model, True, {word.encode()[:3]}).readings(f"you {token}")
    assert X.Restorer(model, True, {b"zzz"}).readings(f"you {token}") == set()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aab é啊.B", max_size=20))
def test_doubled_words_and_their_starts(text):
    assert X.doubled_words(X._plain(text)) == {w for w in X.words(text) if X._TWICE.search(w.decode())}
    for w in X.words(text):
        read = [""]
        for options in X.lattice(w.decode()):
            read = [a + b for a in read for b, _ in options]
        assert {r.encode()[:3] for r in read} <= X._starts(w.decode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aab1! é啊.\nm0rn$", max_size=30), max_size=6))
def test_texts_together_equal_each_alone(texts):
    lines = [(k, line) for k, t in enumerate(texts) for line in t.split("\n") if X._ODD.search(line)]
    assert set(lines) <= set(X.suspicious(texts))
    assert X.doubled([X._plain(t) for t in texts]) == [X.doubled_words(X._plain(t)) for t in texts]
    opens = {b"aab", b"mor", b"a"}
    for w in {w for t in texts for w in X.words(t)}:
        assert X.may_start(w, opens) == (not opens.isdisjoint(X._starts(w.decode())))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aabmor", min_size=1, max_size=9), max_size=8))
def test_decoding_only_what_may_win_changes_no_score(model, tokens):
    share = X.WordModel({b"amor": (9.0, 0.0), b"moa": (3.0, 2.0), b"roma": (5.0, 5.0)}, {b"mor": (2.0, 2.0), b"abb": (4.0, 1.0)})
    restore = X.Restorer(model, True, share.open)
    own, found, twice = next(restore.all_words([" ".join(tokens)]))
    every = {*own, *found}.union(*map(restore.read_twice, twice))
    scores = X.TextScores(share, restore)
    assert scores.of(own, found, twice) == max(map(share, every), default=X.BASE) == scores.of(own, found, twice)
    for w in {w for w in own if X._TWICE.search(w.decode())}:
        assert X.decode(w.decode(), model).encode() in X.shrunk(w, 10**6) and X.decode(w.decode(), model, keep=2).encode() in X.shrunk(w, 10**6)


def test_obfuscated_words_score(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} {'idiot' if i % 2 else 'friend'} here") for i in range(400)]
    odd = ["you iddiot", "you idio7", "an 1 d 1 0 t", "you are a i d i o t", "x-1d10t-x" + "-x" * 20]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert [r.predicted for r in X.scores(df, labels).where("doc_id >= 1000").orderBy("doc_id").collect()] == [1] * len(odd)
    # nothing of this is seen without decoding
    assert [r.predicted for r in X.scores(df, labels, restore=False).where("doc_id >= 1000").orderBy("doc_id").collect()] == [0] * len(odd)


def test_trigrams_equal_slow_counts(spark):
    texts = ["Abc é", None, "", "zz 9z"] * 3
    counts = {}
    for t in texts:
        if t:
            c = [0, 0, *(int(X._CLASS[b]) for b in t.lower().encode()), 0, 0]
            for k in zip(c, c[1:], c[2:]):
                if k != (0, 0, 0):
                    counts[k] = counts.get(k, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {}
    for r in X.trigram_counts(df, "text").collect():
        k = (r.key // X.SYMBOLS**2, r.key // X.SYMBOLS % X.SYMBOLS, r.key % X.SYMBOLS)
        if k != (0, 0, 0):
            got[k] = r.n
    assert got == counts


def test_odd_rows(spark):
    before = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]  # copies of one text would be one piece of evidence
    docs = [(i, [f"{before[i]} fine day", f"what {before[i]} jerk he is", None, "", "..."][i % 5], "c") for i in range(200)]
    df = spark.createDataFrame(docs + [(1, "what a jerk", "c"), (None, "a jerk", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(200)] + [(1, 0), (7, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = X.scores(df, labels).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            assert r.doc_id >= 200 or r.predicted == int(r.doc_id % 5 == 1)
        else:
            assert r.held_out is False
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert {r.predicted for r in X.scores(df, labels.limit(0)).collect()} == {0}
    assert X.scores(df.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame([(i, f"word{'x' if i % 2 else 'y'} number {i}") for i in range(300)], "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(X.scores(df, labels).collect()) == sorted(X.scores(df, turned).collect())


def test_held_out_accuracy(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = [r.score for r in got if r.toxic == 1]
    wrong = [r.score for r in got if r.toxic == 0]
    assert np.mean([s >= 0.7 for s in right]) > 0.9 and np.mean([s >= 0.7 for s in wrong]) < 0.03
    assert np.mean(np.array(right)[:, None] > np.array(wrong)[None, :]) > 0.93
