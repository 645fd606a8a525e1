"""Chunk index on storage: chunks with their embeddings, or with the term
counts that embeddings are weighted from when the index is read.

build -> a new version (an empty or failed build leaves the old one); load ->
DataFrame or None when absent/empty; append -> chunk + embed new documents and
add them in one commit; compact -> fewer, larger files. A chunk is identified
by (doc_id, chunk_index); ``chunk_id`` writes the two as one string.

With ``TermCounts`` as embedder the index keeps raw term counts and, in the
version's totals, how many chunks hold each slot. Appending adds to these
totals in the same commit, and ``load_index`` weights all chunks by the totals
of that version: an index built at once and one that grew by appends read the
same.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import chunk_recursive
from .versions import BUCKETS, Table

Embedder = Callable[[DataFrame], DataFrame]


class TermCounts:
    """Embedder that stores hashed term counts (``tf``); weights come at reading."""

    def __init__(self, dims: int = 1 << 10, text: str = "text"):
        self.dims, self.text = dims, text

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF, RegexTokenizer
        from pyspark.ml.functions import vector_to_array
        tokens = RegexTokenizer(inputCol=self.text, outputCol="_tok", pattern=r"\W+", toLowercase=True).transform(df)
        counts = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=self.dims).transform(tokens)
        return counts.withColumn("tf", vector_to_array("_tf", "float32")).drop("_tok", "_tf")

    @staticmethod
    def totals(chunks: DataFrame) -> dict:
        """Chunks, and of each slot the chunks that hold it: one partial aggregate of a fixed size."""
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer
        held = Summarizer.metrics("numNonZeros", "count").summary(array_to_vector(F.col("tf").cast("array<double>")))
        r = chunks.agg(held.alias("s")).first()["s"]
        return {"chunks": int(r["count"]), "held": [int(x) for x in r["numNonZeros"]]}


def weighted(df: DataFrame, totals: dict) -> DataFrame:
    """``embedding``: term counts times inverse document frequency, of length 1."""
    idf = F.transform(F.array(*[F.lit(float(x)) for x in totals["held"]]), lambda n: F.log((F.lit(totals["chunks"] + 1.0)) / (n + 1.0)))
    raw = df.withColumn("_w", F.zip_with(F.col("tf").cast("array<double>"), idf, lambda t, w: t * w))
    length = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("_n", length).withColumn("embedding", F.transform("_w", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0))).drop("_w", "_n", "tf")


def _table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Table:
    return Table(spark, path, "doc_id", buckets=buckets)


def _chunks_with_vectors(docs: DataFrame, embedder: Embedder) -> DataFrame:
    ch = chunk_recursive(docs)
    ch = ch.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    return embedder(ch)


def build_index(docs: DataFrame, embedder: Embedder, path: str) -> DataFrame:
    """Chunk, embed and save in place of what is there; an input without any
    text is an error and leaves the index as it was."""
    table = _table(docs.sparkSession, path)
    if table.replace(_chunks_with_vectors(docs, embedder), totals=getattr(embedder, "totals", None)) is None:
        raise ValueError("No text content found to index.")
    return load_index(docs.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    table = _table(spark, path)
    state = table.current()
    df = table.read(state)
    return weighted(df, state["totals"]) if df is not None and state["totals"] else df


def add_documents(docs: DataFrame, embedder: Embedder, path: str, stream: tuple[str, int] | None = None) -> DataFrame | None:
    """Append the chunks of new documents; nothing is published when they hold
    no text, or when the named stream's batch is already in."""
    _table(docs.sparkSession, path).append(_chunks_with_vectors(docs, embedder), stream=stream, totals=getattr(embedder, "totals", None))
    return load_index(docs.sparkSession, path)


def compact_index(spark: SparkSession, path: str, most: int = 8) -> None:
    """Rewrite buckets whose chunks lie in more than ``most`` commits."""
    _table(spark, path).compact(most)
