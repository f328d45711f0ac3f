"""Corpus pipeline: language ID, near-duplicate join, secret scan, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Stages are written as Parquet and read again in between, so each begins from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import byte_bpe, jaccard_join, language_id, mixing, secret_scan
from quarrymill.llm.shared import docs_of, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go."""
    return language_id.kept(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return jaccard_join.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs)


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in the mixed order, sources at equal weights; every document stays. The order is that of files and rows, by which tokenize reads them."""
    return mixing.in_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as one stream of tokens: every document's token ids, with digests of ids and of the decoded bytes, its place in the mixed order, and
    the shard of consecutive documents that it falls into, with the number of tokens before it there."""
    return byte_bpe.encode(docs, byte_bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, stream=True)


STAGES = [("language_id", identify), ("ngram_jaccard_join", unique), ("secret_scan", mask_secrets), ("source_mixing", interleave), ("byte_bpe", tokenize)]

#: Language ID and the token merges have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
