"""Reliability and pacing of external service calls, from a table of call events.

Calls: provider, key, ts, seq (breaks ties), code (HTTP status) and seconds (a wait the service
asked for)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Provider, safe calls a minute, safe calls a day (0: unlimited), tier.
PROVIDERS = [
    ("GEMINI", 8, 425, 1), ("GROQ", 24, 850, 2), ("SAMBANOVA", 8, 400, 2), ("COHERE", 16, 850, 2), ("OPENROUTER", 15, 170, 3),
    ("GITHUB", 8, 42, 1), ("KLUSTER", 12, 5000, 3), ("CHUTES", 8, 3000, 3), ("HUGGINGFACE", 7, 2000, 4), ("MISTRAL", 1, 200, 2),
    ("CEREBRAS", 24, 8500, 2), ("TOGETHER", 16, 2000, 3), ("FIREWORKS", 16, 2000, 3), ("GEMMA", 12, 1275, 2),
]


def _in_order() -> WindowSpec:
    return Window.partitionBy("provider", "key").orderBy("ts", "seq")


def _so_far() -> WindowSpec:
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


def _micros(ts: Column) -> Column:
    """Microseconds since 1970, for timestamps with and without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def key_counts(calls: DataFrame) -> DataFrame:
    """provider, key, ok, failed, rejected and success rate (1 without calls)."""
    code = F.col("code")
    out = calls.groupBy("provider", "key").agg(F.count_if(code < 400).alias("ok"), F.count_if(code >= 500).alias("failed"), F.count_if((code >= 400) & (code < 500)).alias("rejected"))
    total = F.col("ok") + F.col("failed") + F.col("rejected")
    return out.withColumn("rate", F.when(total == 0, 1.0).otherwise(F.round(F.col("ok") / total, 4)))


def provider_counts(calls: DataFrame) -> DataFrame:
    """provider, keys, ok, failed, and the mean of its keys' success rates."""
    return key_counts(calls).groupBy("provider").agg(F.count("*").alias("n_keys"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.round(F.avg("rate"), 4).alias("rate"))


def gaps(calls: DataFrame) -> DataFrame:
    """Adds the seconds since the key's previous call."""
    before = F.lag("ts").over(_in_order())
    return calls.withColumn("gap", F.timestamp_diff("MICROSECOND", before, F.col("ts")) / 1e6)


def cooldowns(calls: DataFrame) -> DataFrame:
    """Adds until when (in microseconds) a key rests: a later, shorter wait never shortens it."""
    until = _micros(F.col("ts")) + F.col("seconds") * 1_000_000
    return calls.withColumn("until", F.max(until).over(_so_far()))


def consecutive_errors(calls: DataFrame, error: int = 401, reset: int = 200) -> DataFrame:
    """Adds the number of errors of a kind since the last reset."""
    era = F.count_if(F.col("code") == reset).over(_so_far())
    within = Window.partitionBy("provider", "key", "_era").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("_era", era).withColumn("streak", F.count_if(F.col("code") == error).over(within)).drop("_era")


def smoothed_gap(calls: DataFrame, weight: float = 0.3) -> DataFrame:
    """provider, key and the exponentially smoothed gap after the last call."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "seq", "gap"))).getField("gap")
    fold = lambda acc, x: F.coalesce((1 - weight) * acc + weight * x, acc, x)
    return gaps(calls).groupBy("provider", "key").agg(F.aggregate(ordered, F.lit(None).cast("double"), fold).alias("smoothed"))


def rotation(calls: DataFrame, keys: int) -> DataFrame:
    """Adds the turn of a round robin over a provider's keys."""
    w = Window.partitionBy("provider").orderBy("ts", "seq")
    return calls.withColumn("turn", F.pmod(F.row_number().over(w) - 1, F.lit(keys)))


def masked(key: Column) -> Column:
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), F.length(key))).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("…"), F.right(key, F.lit(4))))


def model_score(avoided: Column, preferred: Column, bonus: Column, rpm: Column, tier: Column) -> Column:
    """Fitness of a model for a role; -1 rules it out."""
    fit = F.when(preferred, 0.40).otherwise(0.0) + bonus + 0.25 * F.least(rpm / 30, F.lit(1.0)) + F.greatest(F.lit(0.0), (4 - tier) * 0.04)
    return F.when(avoided, -1.0).otherwise(fit)
