"""A training-data pipeline over ``documents``: each stage applies one operator to all rows the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import bpe_automaton, exact_dedup, minhash_hamming, mixing, robust_quality
from leadloom.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and lie near the robust estimate of their language and source."""
    return robust_quality.keep_good(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_exact(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8 or more), the one with the least id."""
    return minhash_hamming.keep_one(docs, percent=80).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the hash of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_automaton.round_trip(docs, path)
    return both.select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("robust_quality", good), ("exact_dedup", exact), ("minhash_hamming", near), ("source_mix", mixed), ("bpe_automaton", tokens),
]

#: Robust estimates, near-duplicate components and tokens have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
