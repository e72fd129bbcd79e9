"""The queries of the training-data operators, and their SQL for DuckDB where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import chunks, importance, interpolation, packing, periodic, pieces, pii, quality, simhash, token_scan, toxicity, url_rules, winnowing
from scriptorium.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.with_model(spark, table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.counted(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents"))


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scored(table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_rules": op2_url_rules,
    "op3_winnowing": op3_winnowing,
    "op4_toxicity": op4_toxicity,
    "op5_pieces": op5_pieces,
    "op6_pii": op6_pii,
    "op7_token_scan": op7_token_scan,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
    "op11_interpolation": op11_interpolation,
    "op12_periodic": op12_periodic,
    "op13_importance": op13_importance,
}
ORACLE = {"op2_url_rules": url_rules.oracle(), "op9_quality": quality.ORACLE, "op13_importance": importance.ORACLE}
