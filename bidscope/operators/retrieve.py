"""Exact top-k similarity search and excerpt answers.

The store is a table ``(id, embedding ARRAY<FLOAT|DOUBLE>, ...)``; score is
squared L2 distance, lower is better (an exact flat index).

``similarity_topk`` is one distributed plan. Queries and corpus become block
rows (a bounded number of vectors each, as bytes). Every query block meets
every corpus block by an equi-join on the corpus block's bucket. A task
scores one pair of blocks at a time: a matrix product bounds all distances,
and those that may be among the k best are computed exactly. Each pair of
blocks gives at most k rows per query; a window per query merges them.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_, strip
from ..session import ship_package

# Hits per question.
DEFAULT_K = 6
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096

_BLOCK = "ids binary, vectors binary, n int"


def _whole(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("an id is null")
    return column.to_numpy(zero_copy_only=False).astype("<i8")


def _to_blocks(ids: Sequence[str], vec: str, size: int):
    """mapInArrow body: rows -> blocks of at most ``size`` vectors of one length.
    A task holds the Arrow batch that Spark sends and less than a block of each length."""
    def block(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = sum(len(i) for i, _ in rows)
        both = [np.concatenate(x).tobytes() for x in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array([both[0]], pa.binary()), pa.array([both[1]], pa.binary()), pa.array([n], pa.int32())], names=["ids", "vectors", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        counts: dict[int, int] = {}
        for b in batches:
            vectors, own = b.column(vec), np.stack([_whole(b.column(c)) for c in ids], axis=1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for length in map(int, np.unique(lengths)):
                rows = np.flatnonzero(lengths == length)
                at = 0
                while at < len(rows):
                    take = rows[at:at + size - counts.get(length, 0)]
                    places = (ends[take] - length)[:, None] + np.arange(length)
                    held.setdefault(length, []).append((own[take], flat[places].astype("<f8")))
                    counts[length] = counts.get(length, 0) + len(take)
                    at += len(take)
                    if counts[length] >= size:
                        counts.pop(length)
                        yield block(held.pop(length))
        for rows in held.values():
            yield block(rows)
    return run


def _block_topk(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int):
    """Per query the k nearest rows of ``c``, ties by ids: (query no, row no, exact score)."""
    norm_c, norm_q = (c * c).sum(1), (q * q).sum(1)
    near = norm_q[:, None] - 2.0 * (q @ c.T) + norm_c[None, :]
    slack = 1e-9 * (norm_q[:, None] + norm_c.max(initial=0.0)) + 1e-12
    kth = np.partition(near, k - 1, axis=1)[:, k - 1:k] if near.shape[1] > k else np.full((len(q), 1), np.inf)
    for i in range(len(q)):
        own = np.flatnonzero(near[i] <= kth[i] + 2 * slack[i])
        exact = ((c[own] - q[i]) ** 2).sum(1)
        order = np.lexsort((*ids[own].T[::-1], exact))[:k]
        yield from ((i, own[o], exact[o]) for o in order)


def _score_pairs(k: int, m: int, names: list[str]):
    """mapInArrow body: one pair of blocks at a time, read where the batch holds it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                qi, qv, ci, cv = (np.frombuffer(b.column(c)[at].as_buffer(), dtype=t) for c, t in (("q_ids", "<i8"), ("q_vectors", "<f8"), ("ids", "<i8"), ("vectors", "<f8")))
                qn, cn = (b.column(c)[at].as_py() for c in ("q_n", "n"))
                q, c, ids = qv.reshape(qn, -1), cv.reshape(cn, -1), ci.reshape(cn, m)
                if q.shape[1] != c.shape[1]:
                    continue
                rows = [(qi[i], *ids[j], s) for i, j, s in _block_topk(q, c, ids, k)]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if n == "score" else pa.int64()) for n, x in zip(names, columns)], names=names)
    return run


def similarity_topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K,
                    query_id: str = "query_id", query_vec: str = "embedding",
                    corpus_id: str | Sequence[str] = "id", corpus_vec: str = "embedding",
                    query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """``(query_id, hit_id, rank, score)``: the k nearest corpus rows per
    query by squared L2 (ties by smaller id); scores rounded to 1e-9. With
    several ``corpus_id`` columns these come instead of ``hit_id``. Rows
    without a vector, and pairs of different lengths, take no part."""
    spark = queries.sparkSession
    ship_package(spark)
    one = isinstance(corpus_id, str)
    hit = ["hit_id"] if one else list(corpus_id)
    given = [corpus_id] if one else list(corpus_id)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("v"))
    c = corpus.filter(F.col(corpus_vec).isNotNull()).select(*[F.col(g).cast("long").alias(h) for g, h in zip(given, hit)], F.col(corpus_vec).alias("v"))
    blocks = (q.mapInArrow(_to_blocks(["query_id"], "v", query_block), _BLOCK)
              .select(*[F.col(x).alias(f"q_{x}") for x in ("ids", "vectors", "n")],
                      F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")))
    slices = (c.mapInArrow(_to_blocks(hit, "v", corpus_block), _BLOCK)
              .withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int")))
    schema = ", ".join(["query_id long", *[f"{h} long" for h in hit], "score double"])
    found = slices.join(blocks, "bucket").drop("bucket").mapInArrow(
        _score_pairs(k, len(hit), ["query_id", *hit, "score"]), schema)
    w = Window.partitionBy("query_id").orderBy("score", *hit)
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", *hit, F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score")))


def class_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (one partial aggregate over vectors)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.col(vec).cast("array<double>"))
    return (vectors.groupBy(F.col(label).alias("query_id")).agg(Summarizer.mean(v).alias("m"))
            .select("query_id", vector_to_array("m").alias("embedding")))


def snippet_label(supplier="supplier_name", source="source"):
    def truthy(c):
        c = col_(c)
        return F.when(c.isNotNull() & (c != ""), c)
    return F.coalesce(truthy(supplier), truthy(source), F.lit("Unknown source"))


# Fixed texts of the excerpt answer.
NO_HITS = "No relevant information found in the indexed documents."
EXCERPTS_HEADER = "No model function given — showing the most relevant raw excerpts instead:\n"
PREVIEW_CHARS = 400


def excerpt_answers(hits: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``hits(query_id, rank, text, supplier_name, source)`` -> one answer
    per query: labelled previews in rank order, and beside it the ``sources``
    with rank, label, whole chunk text and preview; a query without hits gets
    the fixed no-result message."""
    preview = strip(F.substring("text", 1, PREVIEW_CHARS))
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", snippet_label().alias("label"), F.col("text"), preview.alias("preview")))).alias("_s"))
    q = queries.select(F.col(query_id).cast("long").alias("query_id")).distinct()
    body = F.array_join(F.transform("_s", lambda s: F.concat(
        F.lit("**"), s["label"], F.lit("**\n> "), s["preview"], F.lit("\n"))), "\n")
    none = F.array().cast("array<struct<rank:int,label:string,text:string,preview:string>>")
    return (q.join(per, "query_id", "left")
             .select("query_id",
                     F.when(F.col("_s").isNull(), F.lit(NO_HITS))
                      .otherwise(F.concat(F.lit(EXCERPTS_HEADER + "\n"), body)).alias("answer"),
                     F.coalesce(F.size("_s"), F.lit(0)).alias("n_sources"), F.coalesce("_s", none).alias("sources")))


def letter_profile(text: str = "text"):
    """JVM-only embedder: the share of each letter a-z among a text's characters,
    in whole thousandths (so distances are exact)."""
    def embed(df: DataFrame) -> DataFrame:
        t = F.lower(F.col(text))
        share = [F.floor((F.length(t) - F.length(F.replace(t, F.lit(x)))) * 1000 / F.greatest(F.length(t), F.lit(1))).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"]
        return df.withColumn("embedding", F.array(*share))
    return embed


def embed_texts(corpus: DataFrame, text_col: str = "text", dims: int = 1 << 10):
    """Stand-in embedder (plug point): Tokenizer -> HashingTF -> IDF ->
    Normalizer fitted on ``corpus``; returns a function that embeds any
    DataFrame with ``text_col`` into ``embedding ARRAY<DOUBLE>``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)])
    model = pipe.fit(corpus.select(text_col))

    def embed(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("embedding", vector_to_array("_vec")).drop("_tok", "_tf", "_idf", "_vec")
    return embed


def qa_context(hits: DataFrame) -> DataFrame:
    """Per query, the context handed to an answering model: each hit as
    ``[label]`` + newline + full chunk text, in rank order, separated by a
    blank line."""
    piece = F.concat(F.lit("["), snippet_label(), F.lit("]\n"), F.col("text"))
    per = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))).alias("_p"))
    return per.select("query_id", F.array_join(F.transform("_p", lambda s: s["p"]), "\n\n")
                      .alias("context"))
