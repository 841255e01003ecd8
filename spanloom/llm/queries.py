"""The operators' queries over the whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, crossalign, language_id, license_scan, line_dedup, maxscore, nearest, packing, quality_rules, simhash, token_counts, toxicity, whitening
from spanloom.plans.shared import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_documents(spark, sf_dir))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spread(_embeddings(spark, sf_dir)))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossalign.align_tokenizers(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_maxscore": op11_maxscore,
    "op12_whitening": op12_whitening,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.RULES_SQL,
    "op7_line_dedup": line_dedup.SUMMARY_SQL,
    "op11_maxscore": maxscore.SEARCH_SQL,
}
