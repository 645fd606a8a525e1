"""Registered queries of the dealt operators, each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_main, kk_shards, language_id, line_dedup, merkle, packing, simhash, spelling, suffix_dedup, topk_kd, toxicity, url_filter
from .oracle_sql import SQL
from .tables import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_shards.shard_by_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontam.digest(scanned)


def op8_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_kd.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents", *merkle.FIELDS))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_simhash, op4_toxicity, op5_main_text, op6_kk_shards, op7_decontamination, op8_kd_topk, op9_url_filter, op10_pattern_packing, op11_merkle_manifest, op12_language_id, op13_spelling_variants)}

__all__ = ["QUERIES", "SQL"]
