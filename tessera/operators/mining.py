"""Rule candidates: hits in blocks, their upsert, and the states they pass through.

A candidate is waiting (kandidat), put forward (na_cekanju), confirmed (potvrden), active (aktivan),
rejected (odbijen), rolled back (rollback) or for information only (info). All steps return new
tables; nothing is changed in place, so a scan can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the state machine.
MIN_SEEN, MIN_BOOKS = 3, 2
PROMOTE_SEEN, PROMOTE_BOOKS, PROMOTE_SCORE, REJECT_SCORE = 5, 2, 8.2, 8.8
STRONG_SCORE, MAX_ROLLBACKS = 7.5, 2
NEVER = ["rod_mijesanje", "info"]


def hits(blocks: DataFrame, rules: list[tuple[str, str]], text: str = "text", around: int = 60) -> DataFrame:
    """A row for each block and rule that matches: the rule, its kind, the first match and its
    surroundings. Rules are literals, so each block is read once and no join is needed."""
    found = []
    for pattern, kind in rules:
        match = F.regexp_extract(text, f"(?iU)({pattern})", 1)
        at = F.instr(F.col(text), match)
        context = F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.length(match) + 2 * around)
        found.append(F.when(F.col(text).rlike(f"(?iU){pattern}"), F.struct(F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind"), match.alias("match"), context.alias("context"))))
    return blocks.withColumn("_hit", F.explode(F.array_compact(F.array(*found)))).select("*", "_hit.*").drop("_hit")


def upsert(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates after a scan, one row per (pattern, kind): counts and score sums add up, books
    unite, the latest context wins. Both tables: pattern, kind, n, score_sum, books, context, seq."""
    both = old.unionByName(seen)
    return both.groupBy("pattern", "kind").agg(
        F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("books")))).alias("books"),  # a set: distinct before the shuffle
        F.max_by("context", "seq").alias("context"), F.max("seq").alias("seq"),
    )


def validated(n: Column, books: Column, average: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin(NEVER), "info")
        .when(average > REJECT_SCORE, "odbijen")
        .when((n >= PROMOTE_SEEN) & (books >= PROMOTE_BOOKS) & (average <= PROMOTE_SCORE), "na_cekanju")
        .otherwise("kandidat")
    )


def promoted(average: Column, rollbacks: Column) -> Column:
    return F.when(rollbacks >= MAX_ROLLBACKS, "odbijen").when(average < STRONG_SCORE, "aktivan:strong").when(average < PROMOTE_SCORE, "aktivan").otherwise("odbijen")


# Sightings: one row a pattern, book and chunk, from the newest scan that saw it


def sightings(seen: DataFrame) -> DataFrame:
    """Scans as one table: pattern, book, chunk, and kind, score, context and scan of the newest scan
    that saw the pattern there, with the first and last scan. A scan that is repeated, whole or in
    part, replaces itself, so it counts once. seen: pattern, kind, book, chunk, score, context, scan."""
    newest = F.max_by(F.struct("kind", "score", "context"), "scan").alias("s")
    made = seen.groupBy("pattern", "book", "chunk").agg(newest, F.min("scan").alias("first_scan"), F.max("scan").alias("scan"))
    return made.select("pattern", "book", "chunk", "s.*", "first_scan", "scan")


def patterns_of(rows: DataFrame) -> DataFrame:
    """Sightings by pattern and kind: n, score_sum, n_books."""
    return rows.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score_sum"), F.count_distinct("book").alias("n_books"))


def unapplied(patterns: DataFrame, applied: DataFrame, base: DataFrame) -> DataFrame:
    """Patterns that are neither applied yet nor in the base list."""
    return patterns.join(applied.select("pattern"), "pattern", "left_anti").join(base.select("pattern"), "pattern", "left_anti")


class SightingStore:
    """Sightings on disk, a folder per scan: writing a scan again replaces it, whatever came of the first attempt."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, seen: DataFrame, scan: int) -> None:
        seen.drop("scan").write.mode("overwrite").parquet(f"{self.path}/scan={scan}")

    def read(self, spark: SparkSession) -> DataFrame:
        return sightings(spark.read.parquet(self.path).withColumn("scan", F.col("scan").cast("long")))
