"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import chat, decontam, divergence, langid, lines, minhash, perfect, permutation, pieces, spelling, toxicity, windows, xent
from matchloom.llm.tables import load
from matchloom.plans.ship import ship


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.report(load(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return windows.report(load(spark, sf_dir, "documents"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return permutation.report(load(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.report(load(spark, sf_dir, "documents"), k=4, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(load(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.report(load(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(load(spark, sf_dir, "conversations"))


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return xent.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return divergence.report(load(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling.report(load(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return perfect.report(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_permutation_index": op3_permutation_index,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_fuzzy_line_dedup": op7_fuzzy_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_cross_entropy": op10_cross_entropy,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
}
