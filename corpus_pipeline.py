"""Corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing,
SentencePiece encoding, each stage written and read again as the next one's input.

All stages but the last return the columns of ``documents``; the last returns
doc_id, ids, n_tokens, n_byte_tokens and round_trip of every document left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustframe.llm import jaccard_join, mixing, quality_rules, secret_scan, unigram
from gustframe.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's budget takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return unigram.encode(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("secret_scan", secrets), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The SentencePiece stage has no SQL form; tests compare it with brute force.
ORACLE_SQL = None
