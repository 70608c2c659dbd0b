"""A pipeline over the documents table: quality, exact and near duplicates, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import bpe, exact_dedup, minhash, mixing, quality
from tallywright.session import small_batches, written

#: Words that a worker remembers in a task of the last stage; its executor still holds what the stages before took.
MEMORY_WORDS = 50_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repeated words; null and short texts go, an empty table stays empty."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal apart from white space, the longest original, then the smallest id; one of repeated rows stays."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest id; texts without words are linked with nothing."""
    return minhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for; null sources are one source, sizes of 0 do not count."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of each row, as counts and digests; a null text has no tokens, repeated rows give a row each."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with small_batches(spark):
        return written(bpe.round_trip(docs, ranks, pattern, memory_words=MEMORY_WORDS, forget=True), "tokens")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: SQL cannot state byte-level BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's output is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
