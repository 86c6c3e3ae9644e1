"""From raw documents to a clean, deduplicated, decontaminated and tokenised corpus.

Five stages, each over all that the one before kept: quality rules, line dedup, near-dedup,
benchmark decontamination, byte-level BPE. Each stage's result is written and read again.

Null and empty texts fail the quality rules and go there; run on their own, the later stages keep
null texts as they are, and count null and empty texts as one class of copies. Very long texts are
read whole. Of rows that tie, repeated ones included, near-dedup keeps the one of least id, null
last; all other stages treat them alike. Empty tables give empty tables. Extra columns, whatever
their names, pass through all stages but the last, whose columns are its own. `n_chars` follows a
changed text if there is such a column.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, line_dedup, near_dups, quality
from tessera.llm._spark import materialise

RANKS = "byte_bpe_50k.tiktoken"


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    return bpe.token_digests(docs, public_tokenizers.path(RANKS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: SQL states neither the order-MinHash nor the tokenising stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
