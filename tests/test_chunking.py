"""Chunking properties and the recursive splitter's behaviour."""
from pyspark.sql import functions as F

from bidscope.operators.chunking import chunk_fixed, chunk_recursive, recursive_split


def test_recursive_split_properties():
    text = ("Para one line one.\nline two is here.\n\n" + "word " * 400 + "\n\n" + "x" * 2000)
    chunks = recursive_split(text, 800, 120)
    assert all(0 < len(c) <= 800 for c in chunks)
    assert chunks[0].startswith("Para one")
    assert "".join(chunks).replace(" ", "").replace("\n", "").count("x") >= 2000
    assert recursive_split("short text") == ["short text"]
    assert recursive_split("   \n\n  ") == []


def test_overlap_between_word_chunks():
    text = " ".join(f"w{i}" for i in range(1000))
    chunks = recursive_split(text, 100, 20)
    assert all(len(c) <= 100 for c in chunks)
    for a, b in zip(chunks, chunks[1:]):
        assert a.split()[-1] in b.split()[:5]


def test_chunk_recursive_dataframe(spark):
    docs = spark.createDataFrame([(1, "a " * 1000, "s1"), (2, "   ", "s2"), (3, "tiny", None)],
                                 "doc_id long, raw_text string, source string")
    ch = chunk_recursive(docs).collect()
    assert {r.doc_id for r in ch} == {1, 3}
    assert all(len(r.text) <= 800 for r in ch)
    assert [r.source for r in ch if r.doc_id == 3] == ["unknown"]
    idx = sorted(r.chunk_index for r in ch if r.doc_id == 1)
    assert idx == list(range(len(idx)))


def test_chunk_fixed(spark):
    docs = spark.createDataFrame([(1, "x" * 2000)], "doc_id long, raw_text string")
    ch = chunk_fixed(docs).orderBy("chunk_index").collect()
    assert [r.start for r in ch] == [1, 681, 1361]
    assert [len(r.text) for r in ch] == [800, 800, 640]
    assert ch[0].text[680:] == ch[1].text[:120]
    _ = F
