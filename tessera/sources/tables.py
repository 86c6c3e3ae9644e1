"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts: work on them is bound by CPU, not by reading.
TEXTS = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than two a core, dealt to all cores: one row group is one task's work,
    whatever the splits. Larger tables have splits enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXTS else df
