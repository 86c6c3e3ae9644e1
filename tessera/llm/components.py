"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import discard, materialise


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for all ends of the edges (a, b).

    Each round, a node takes the least node next to it, then that node's. The edges between what is
    left, and from a node taken to the one that it took itself, are the next round's, far fewer: a
    group around one node is gone after the first. Every round is a written table; at the end the
    rounds are joined in turn."""
    left, rounds = materialise(_edges(edges), "edges"), []
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        taken = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("took"))
        further = taken.select(F.col("node").alias("took"), F.col("took").alias("label"))
        step = materialise(taken.join(further, "took").select("node", "label"), "step")
        at = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        chained = step.select(F.col("label").alias("a")).distinct().join(at("a"), "a").select("a", F.col("label_a").alias("b"))
        after = materialise(_edges(moved.union(chained)), "edges")
        discard(left)
        left = after
        rounds.append(step)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0]
    for step in rounds[1:]:
        on = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(on, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = materialise(labels, "labels")
    discard(left, *rounds)
    return labels
