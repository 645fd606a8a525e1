"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; its decisions take effect. All stages but the
last keep the columns of ``docs``. ``run`` writes each stage's rows as Parquet
under the cluster's shared folder and reads them back for the next.

1. toxicity: documents scored 0.7 or more go.
2. line dedup: repeated lines go from the texts; no document goes, a text may
   become empty; ``n_chars`` follows the text.
3. SimHash near-dedup: of each component the document with the smallest
   doc_id stays, and once only if a row is repeated.
4. benchmark decontamination: documents that hold a window of an item go.
5. packing: all kept documents as pieces in sequences.

Null texts pass the filters (no words, no lines); as all empty texts have
fingerprint zero, one of these stays after stage 3. Empty tables pass.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.llm import decontam, line_dedup, packing, simhash, toxicity
from bidscope.llm.tables import drop, stored, table

TOXIC = 0.7


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _new(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _new(docs, "toxicity_score")
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), name=score)
    return scored.where(F.col(score) < TOXIC).select(*_own(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _new(docs, "document_key")
    # the digest tells rows apart that share a doc_id or have none
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("digest")))
    groups = simhash.near_duplicates(keyed, doc_id=key)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    nth = _new(docs, "nth")
    kept = keyed.join(first, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return kept.where(F.col(nth) == 1).select(*_own(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]
#: SQL can't express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs
