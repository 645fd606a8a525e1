"""Registered retrieval queries: chunking, exact top-k, answers, index."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import approx, chunking, index_store, retrieve
from ..session import scratch
from ..sources.tables import read_table
from .queries import query


def _docs(spark, d):
    return read_table(spark, d, "documents", "doc_id", "text", "source").withColumnRenamed(
        "text", "raw_text")


def _written(df):
    """Rows that a query reads more than once, computed once."""
    path = scratch(df.sparkSession, "chunks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("chunk_fixed")
def q_chunk_fixed(spark, d):
    return chunking.chunk_fixed(_docs(spark, d))


def _covered(chunks, docs):
    """Per document: whether all chunks are at most 800 characters and stand
    at their place in the text, and the non-blank characters outside of all
    chunks."""
    per = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", F.length("text").alias("n"), F.xxhash64("text").alias("h")))).alias("c"))
    d = docs.select("doc_id", "raw_text").join(per, "doc_id")
    text = lambda at, n: F.substring(F.col("raw_text"), at.cast("int"), n.cast("int"))
    ok = F.forall("c", lambda x: (x["n"] <= 800) & (F.xxhash64(text(x["start"], x["n"])) == x["h"]))
    # what lies between the furthest end so far and the next start
    skipped = F.aggregate("c", F.struct(F.lit(1).cast("long").alias("end"), F.lit("").alias("rest")), lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
        F.concat(s["rest"], text(s["end"], F.greatest(F.lit(0), x["start"] - s["end"]))).alias("rest")))
    out = d.withColumn("ok", ok).withColumn("s", skipped)
    rest = F.concat("s.rest", text(F.col("s.end"), F.length("raw_text")))
    return out.select("doc_id", F.col("ok").alias("chunks_ok"), F.length(F.regexp_replace(rest, r"[\s\u001c-\u001f\u0085\u00a0]+", "")).alias("uncovered"))


@query("chunk_recursive")
def q_chunk_recursive(spark, d):
    """Recursive chunks, reported per document: sizes and places are right and
    no non-blank character is lost."""
    docs = _docs(spark, d)
    return _covered(chunking.chunk_recursive(docs), docs)


def _centroids(spark, d):
    return retrieve.class_centroids(read_table(spark, d, "embeddings", "label", "embedding"))


@query("similarity_topk")
def q_similarity_topk(spark, d):
    corpus = read_table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieve.similarity_topk(_centroids(spark, d), corpus, corpus_id="vec_id")


@query("ask_answer")
def q_ask_answer(spark, d):
    """Benchmark passages as questions against the chunks of every document,
    embedded by letter profile; excerpt answers with their sources."""
    embed = retrieve.letter_profile("text")
    chunks = _written(embed(chunking.chunk_fixed(_docs(spark, d))))
    qs = embed(read_table(spark, d, "benchmark", "item_id", "text"))
    hits = retrieve.similarity_topk(qs, chunks, query_id="item_id", corpus_id=("doc_id", "chunk_index"))
    hits = hits.join(chunks.select("doc_id", "chunk_index", "text", "source", "supplier_name"), ["doc_id", "chunk_index"])
    answers = retrieve.excerpt_answers(hits, qs, "item_id")
    joined = lambda f: F.array_join(F.transform("sources", lambda s: s[f]), "\u001e")
    return answers.select("query_id", "answer", "n_sources", joined("label").alias("source_labels"), joined("text").alias("source_texts"))


def embedded_hits(spark, d):
    """Benchmark passages against document chunks, embedded by the stand-in
    TF-IDF embedder fitted on the chunks: (hits, questions, chunks)."""
    chunks = _written(chunking.chunk_fixed(_docs(spark, d)))
    embed = retrieve.embed_texts(chunks, "text", 256)
    qs, store = embed(read_table(spark, d, "benchmark", "item_id", "text")), embed(chunks)
    return retrieve.similarity_topk(qs, store, query_id="item_id", corpus_id=("doc_id", "chunk_index")), qs, store


@query("embed_topk")
def q_embed_topk(spark, d):
    """Per question: number of hits, their ranks, and whether scores ascend."""
    hits, _, _ = embedded_hits(spark, d)
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("h"))
    scores = F.transform("h", lambda x: x["score"])
    return per.select(F.col("query_id").alias("item_id"), F.size("h").alias("n_hits"), F.array_join(F.transform("h", lambda x: x["rank"].cast("string")), ",").alias("ranks"),
                      ((scores == F.array_sort(scores)) & (F.array_min(scores) >= 0)).alias("ascending"))


@query("index_append")
def q_index_append(spark, d):
    """Build the chunk index from all documents, append the benchmark passages
    as new documents, load it back; reported per kind and document."""
    path = scratch(spark, "chunk_index")
    docs = _docs(spark, d)
    embed = retrieve.letter_profile("text")
    index_store.build_index(docs, embed, path)
    extra = read_table(spark, d, "benchmark", "item_id", "text").select(
        (-F.col("item_id") - 1).alias("doc_id"), F.col("text").alias("raw_text"), F.lit("benchmark").alias("source"))
    index = index_store.add_documents(extra, embed, path)
    sizes = index.groupBy("doc_id").agg(F.min(F.size("embedding")).alias("dims"), F.count_distinct("chunk_id").alias("ids"), F.count("*").alias("n"),
                                        F.first("source").alias("source"))
    every = docs.select("doc_id", "raw_text").unionByName(extra.select("doc_id", "raw_text"))
    return _covered(index, every).join(sizes, "doc_id").select(
        "doc_id", "source", "dims", (F.col("ids") == F.col("n")).alias("ids_differ"), "chunks_ok", "uncovered")


def _passages(spark, d):
    return read_table(spark, d, "benchmark", "item_id", "text").select(
        (-F.col("item_id") - 1).alias("doc_id"), F.col("text").alias("raw_text"), F.lit("benchmark").alias("source"))


@query("index_versions")
def q_index_versions(spark, d):
    """The index over its versions: built, kept through a build without text,
    appended to twice, compacted, read back; per document its chunks are whole
    and each is there once."""
    path, docs, extra = scratch(spark, "chunk_index"), _docs(spark, d), _passages(spark, d)
    embed = retrieve.letter_profile("text")
    index_store.build_index(docs, embed, path)
    kept = True
    try:
        index_store.build_index(docs.withColumn("raw_text", F.lit(" ")), embed, path)
        kept = False
    except ValueError:
        pass
    odd = F.col("doc_id") % 2 != 0
    index_store.add_documents(extra.where(odd), embed, path)
    index_store.add_documents(extra.where(~odd), embed, path)
    index_store.compact_index(spark, path, most=1)
    index = index_store.load_index(spark, path)
    once = index.groupBy("doc_id").agg((F.count_distinct("chunk_id") == F.count("*")).alias("chunks_once"))
    every = docs.select("doc_id", "raw_text").unionByName(extra.select("doc_id", "raw_text"))
    return _covered(index, every).join(once, "doc_id").select("doc_id", "chunks_ok", "uncovered", "chunks_once", F.lit(kept).alias("old_kept"))


@query("index_statistics")
def q_index_statistics(spark, d):
    """Term weights of an index built at once and of one that grew by appends:
    per document, whether every chunk has the same vector in both, of length 1
    (or 0 for a chunk without words)."""
    docs, extra, count = _docs(spark, d), _passages(spark, d), index_store.TermCounts(256)
    every = docs.select("doc_id", "raw_text", "source").unionByName(extra)
    whole, grown = scratch(spark, "index_whole"), scratch(spark, "index_grown")
    index_store.build_index(every, count, whole)
    index_store.build_index(docs, count, grown)
    index_store.add_documents(extra.where("doc_id % 2 = 0"), count, grown)
    index_store.add_documents(extra.where("doc_id % 2 <> 0"), count, grown)
    a, b = (index_store.load_index(spark, p).select("doc_id", "chunk_index", F.col("embedding").alias(n)) for p, n in ((whole, "a"), (grown, "b")))
    length = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    same = F.coalesce((F.col("a") == F.col("b")) & ((F.abs(length - 1) < 1e-9) | (length == 0)), F.lit(False))
    return a.join(b, ["doc_id", "chunk_index"], "full").groupBy("doc_id").agg(F.min(same).alias("same"))


@query("approx_topk")
def q_approx_topk(spark, d):
    """Benchmark passages against the chunks of all documents through the
    bucket index, beside the exact search: per passage its number of hits,
    and whether all passages together find at least nine tenths."""
    embed = retrieve.letter_profile("text")
    chunks, ids = _written(embed(chunking.chunk_fixed(_docs(spark, d))).select("doc_id", "chunk_index", "embedding")), ["doc_id", "chunk_index"]
    qs = embed(read_table(spark, d, "benchmark", "item_id", "text")).select(F.col("item_id").alias("query_id"), "embedding")
    index = approx.build_buckets(chunks, scratch(spark, "buckets"), ids, rows_a_bucket=256)
    found = approx.approx_topk(qs, index)
    common = approx.measured_recall(found, retrieve.similarity_topk(qs, chunks, corpus_id=ids), ids)
    share = common.agg((F.sum("n_common") >= 0.9 * F.sum("n_exact")).alias("recall_reached"))
    hits = found.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").cast("int").alias("n_hits"), F.max("rank").alias("last_rank"))
    one = F.lit(1).alias("one")
    return hits.select("*", one).join(share.select("*", one), "one").drop("one")
