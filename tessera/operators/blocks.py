"""Blocks of long texts, their neighbours, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def chunk_paragraphs(text: Column, max_words: int) -> Column:
    """Arrays of paragraphs, packed greedily: a block closes when the next paragraph would take it
    over max_words; a longer paragraph stays whole, one without words joins the open block."""
    parts = F.transform(F.split(text, "\n"), lambda p: F.struct(p.alias("p"), T.word_count(p).alias("w")))
    start = F.struct(F.array().cast("array<struct<parts:array<string>,n:bigint>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        closes = (acc["n"] > 0) & (acc["n"] + x["w"] > max_words)
        closed = F.array_append(acc["done"], F.struct(acc["open"].alias("parts"), acc["n"].alias("n")))
        return F.struct(
            F.when(closes, closed).otherwise(acc["done"]).alias("done"),
            F.when(closes, F.array(x["p"])).otherwise(F.array_append(acc["open"], x["p"])).alias("open"),
            F.when(closes, x["w"]).otherwise(acc["n"] + x["w"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["open"].alias("parts"), acc["n"].alias("n"))
        return F.filter(F.array_append(acc["done"], last), lambda b: b["n"] > 0)

    return F.aggregate(parts, start, step, finish)


def blocks(docs: DataFrame, key: str, text: str, max_words: int = 800) -> DataFrame:
    """key, block (from 0), n_words and text of every block."""
    out = docs.select(key, F.posexplode(chunk_paragraphs(F.coalesce(text, F.lit("")), max_words)).alias("block", "b"))
    return out.select(key, "block", F.col("b.n").alias("n_words"), F.array_join("b.parts", "\n").alias("text"))


def with_context(rows: DataFrame, key: str, order: str, text: str, before: int = 600, after: int = 400, none: str = "") -> DataFrame:
    """Adds the end of the previous and the start of the next block."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.coalesce(F.right(F.lag(text).over(w), F.lit(before)), F.lit(none))).withColumn("after", F.coalesce(F.left(F.lead(text).over(w), F.lit(after)), F.lit(none)))


def reassemble(rows: DataFrame, key: str, order: str, text: str, fallback: str) -> DataFrame:
    """One text per key, blocks in order; a missing block falls back to its original."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, fallback).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(parts.getField("t"), "\n").alias("text"), F.count("*").alias("n_blocks"))


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows in order up to the first that would exceed the budget; that one and all after it go."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


# Noun endings by case for names that end in a consonant, and in -a.
CASES = ["N", "G", "D", "A", "V", "I", "L"]
MALE = ["", "a", "u", "a", "e", "om", "u"]
FEMALE = ["a", "e", "i", "u", "o", "om", "i"]


def decline(name: Column) -> Column:
    """Seven cases of a name; names in -a (not -ica) decline as feminine."""
    female = name.endswith("a") & ~name.endswith("ica")
    stem = F.when(name.endswith("a"), F.expr("''").cast("string")).otherwise(name)
    stem = F.when(name.endswith("a"), F.substr(name, F.lit(1), F.length(name) - 1)).otherwise(stem)
    forms = [F.when(female | name.endswith("a"), F.concat(stem, F.lit(f))).otherwise(F.concat(stem, F.lit(m))) for m, f in zip(MALE, FEMALE, strict=True)]
    return F.map_from_arrays(F.array(*map(F.lit, CASES)), F.array(*forms))
