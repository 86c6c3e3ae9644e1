"""Numbers and heads of ordered rows without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200


def global_row_number(rows: DataFrame, order: str, into: str) -> DataFrame:
    """Numbers rows from 1 by a numeric column: rows are cut into equal ranges of it, counted per
    range, and numbered within."""
    low, high = rows.agg(F.min(order), F.max(order)).head()
    width = 1 if low is None else max(1, -(-(high - low + 1) // RANGES))
    ranged = rows.withColumn("_range", ((F.col(order) - (low or 0)) / width).cast("long"))
    counts = ranged.groupBy("_range").count()
    firsts = counts.withColumn("_first", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(F.broadcast(firsts.drop("count")), "_range").withColumn(into, (F.col("_first") + within).cast("long")).drop("_range", "_first")


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n per key and task before it shuffles."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_number", number).where(F.col("_number") <= n).drop("_number")
