"""Names in texts: counts, groups, and gender from clues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME = r"[A-ZČĆŠŽĐ][a-zčćšžđ]{2,}"
MIN_CLUES = 3


def proper_nouns(docs: DataFrame, keys: list[str], text: str = "text", least: int = 2) -> DataFrame:
    """Capitalised tokens of three letters or more with their counts, from `least` on."""
    tokens = docs.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))).alias("name"))
    return tokens.groupBy(*keys, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gender(clues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The gender each name first gets: the first prefix of its clues with three of one kind and
    more than of the other decides, and stays decided. clues: keys, order, clue ('M' or 'Ž')."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = clues.withColumn("m", F.count_if(F.col("clue") == "M").over(w)).withColumn("f", F.count_if(F.col("clue") == "Ž").over(w))
    verdict = F.when((F.col("m") >= MIN_CLUES) & (F.col("m") > F.col("f")), "M").when((F.col("f") >= MIN_CLUES) & (F.col("f") > F.col("m")), "Ž")
    marked = counted.withColumn("verdict", verdict)
    place = F.struct(*order)
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("clue") == "M").alias("clue_m"), F.count_if(F.col("clue") == "Ž").alias("clue_f"),
        F.min_by("verdict", F.when(F.col("verdict").isNotNull(), place)).alias("gender"),
    )


def with_glossary(decided: DataFrame, glossary: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions, with those of a glossary (keys, gender) first: its names have its gender and clues
    enough for it, whether or not a text tells of them. Other genders than 'M' and 'Ž' say nothing."""
    given = glossary.where(F.col("gender").isin("M", "Ž")).groupBy(*keys).agg(F.min("gender").alias("given"))
    joined = decided.join(given, keys, "full")
    count = lambda c, g: F.greatest(F.coalesce(c, F.lit(0)), F.when(F.col("given") == g, MIN_CLUES).otherwise(0)).cast("long").alias(c)
    return joined.select(*keys, count("clue_m", "M"), count("clue_f", "Ž"), F.coalesce("given", "gender").alias("gender"))
