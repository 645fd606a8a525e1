"""Exact top-k against brute force; excerpt answers."""
import numpy as np
from bidscope.operators.retrieve import excerpt_answers, similarity_topk


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(700, 16)).astype(np.float32)
    queries = rng.normal(size=(9, 16))
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                "id long, embedding array<float>").repartition(5)
    qdf = spark.createDataFrame([(100 + i, [float(x) for x in v]) for i, v in enumerate(queries)],
                                "query_id long, embedding array<double>")
    got = similarity_topk(qdf, cdf, k=6, query_block=4, corpus_block=90).collect()   # several blocks on both sides
    d = ((corpus.astype(np.float64)[None, :, :] - queries[:, None, :]) ** 2).sum(-1)
    for qi in range(len(queries)):
        want = list(np.lexsort((np.arange(700), d[qi]))[:6])
        mine = [r.hit_id for r in sorted((r for r in got if r.query_id == 100 + qi), key=lambda r: r.rank)]
        assert mine == want


def test_excerpt_answers(spark):
    hits = spark.createDataFrame([(1, 2, "  second  ", None, "b.pdf"), (1, 1, "first", "Acme", "a.xlsx")],
                                 "query_id long, rank int, text string, supplier_name string, source string")
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    a = {r.query_id: r for r in excerpt_answers(hits, qs).collect()}
    assert a[2].answer == "No relevant information found in the indexed documents." and a[2].n_sources == 0
    assert a[1].answer.endswith("**Acme**\n> first\n\n**b.pdf**\n> second\n")
    assert [(s["rank"], s.label, s.text, s.preview) for s in a[1].sources] == [(1, "Acme", "first", "first"), (2, "b.pdf", "  second  ", "second")]
    assert a[2].sources == []


def test_ties_and_several_ids(spark):
    rows = [(d, c, [float(d % 3), 1.0]) for d in range(30) for c in range(3)] + [(99, 0, None)]
    corpus = spark.createDataFrame(rows, "doc_id long, chunk_index int, embedding array<double>").repartition(4)
    qs = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    got = similarity_topk(qs, corpus, k=5, corpus_id=("doc_id", "chunk_index"), corpus_block=7).orderBy("rank").collect()
    assert [(r.doc_id, r.chunk_index, r.score) for r in got] == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0), (3, 0, 0.0), (3, 1, 0.0)]


def test_a_document_without_a_stored_vector_can_answer(spark):
    from bidscope.plans.registry import QUERIES
    sf = "/root/testdata/sf0.001"
    stored = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    parts = [p for r in QUERIES["ask_answer"](spark, sf).collect() for p in r.source_texts.split("\u001e")]
    answered = {i for i, t in text.items() if t and any(p in t for p in parts)}
    assert answered and (answered - stored or stored >= set(text))


def test_embedded_hits_equal_brute_force(spark):
    from bidscope.plans.retrieve_queries import embedded_hits
    hits, qs, store = embedded_hits(spark, "/root/testdata/sf0.001")
    q = {r.item_id: np.array(r.embedding) for r in qs.select("item_id", "embedding").collect()}
    rows = sorted((r.doc_id, r.chunk_index, r.embedding) for r in store.select("doc_id", "chunk_index", "embedding").collect())
    c = np.array([r[2] for r in rows])
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index))
    for i, v in q.items():
        d = ((c - v) ** 2).sum(1)
        assert got[i] == [rows[k][:2] for k in np.lexsort((np.arange(len(d)), d))[:6]]
