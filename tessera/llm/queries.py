"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, embeddings, language_model, line_dedup, merkle, near_dups, quality, sharding, substring, toxicity, trie, urls
from tessera.llm.oracles import oracles

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=40, seed=17)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op7_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classify(_table(spark, sf_dir, "documents"))


def op9_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_windows(_table(spark, sf_dir, "documents"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_quality_rules": op2_quality_rules,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pu_toxicity": op5_pu_toxicity,
    "op6_patience_line_dedup": op6_patience_line_dedup,
    "op7_pigeonhole_decontamination": op7_pigeonhole_decontamination,
    "op8_order_minhash": op8_order_minhash,
    "op9_super_kmer_dedup": op9_super_kmer_dedup,
    "op10_url_templates": op10_url_templates,
    "op11_subspace_join": op11_subspace_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = oracles(URL_RULES)
