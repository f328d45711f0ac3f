"""The queries opN_<name>: each applies its operator with production parameters to the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chunk_dedup, jaccard_join, language_id, manifest, media, merkle, mixing, oracles, page_text, prefix_trie, quality, secret_scan, suffix_dedup
from .shared import docs_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(docs_of(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(docs_of(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs_of(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_of(spark, sf_dir).select("doc_id", "source"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(docs_of(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(docs_of(spark, sf_dir), byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(docs_of(spark, sf_dir)))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(docs_of(spark, sf_dir))


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(docs_of(spark, sf_dir))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.build(*prefix_trie.spliced(prefix_trie.turns(conversations)))


def queries() -> dict[str, Query]:
    numbered = (
        op1_document_fingerprints, op2_ngram_jaccard_join, op3_suffix_dedup, op4_source_mixing, op5_quality_classifier, op6_media_columns, op7_language_id, op8_byte_bpe, op9_secret_scan, op10_chunk_dedup,
        op11_dataset_manifest, op12_page_text, op13_conversation_trie,
    )
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
