"""Call health over a stream: windowed counts behind a watermark, and sessions of use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_health(calls: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and failures per provider and window; works on a stream or a table."""
    source = calls.withWatermark("ts", late) if calls.isStreaming else calls
    counted = source.groupBy(F.window("ts", window).alias("w"), "provider").agg(F.count("*").alias("n"), F.count_if(F.col("code") >= 400).alias("bad"))
    return counted.select("provider", F.col("w.start").alias("start"), "n", "bad")


def use_sessions(calls: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's use that end after a pause."""
    source = calls.withWatermark("ts", late) if calls.isStreaming else calls
    counted = source.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("key", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what is there through to parquet and stops; a rerun continues from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
