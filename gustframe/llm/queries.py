"""Registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (chat, hamming_topk, hard_negatives, jaccard_join, language_id, licences, mixing, quality_rules, secret_scan, sharding,
               token_alignment, token_counts, unigram)
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = hamming_topk.top_k(vectors, hamming_topk.every_hundredth(vectors), k=10, dims=64)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbour_id", "distance")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_shifted(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_sharding, op3_chat_snapshots, op4_sentencepiece, op5_license_scan, op6_secret_scan,
                            op7_token_counts, op8_quality_rules, op9_jaccard_join, op10_hamming_topk, op11_hard_negatives, op12_language_id,
                            op13_token_alignment)}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.oracle_sql(), "op2_sharding": sharding.ORACLE, "op3_chat_snapshots": chat.ORACLE,
    "op8_quality_rules": quality_rules.oracle_sql(), "op9_jaccard_join": jaccard_join.ORACLE, "op10_hamming_topk": hamming_topk.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE}
