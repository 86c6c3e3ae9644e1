"""Merkle manifest of a dataset: per language a tree over the rows' digests, and a root over all.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A leaf is H of
the row's fields (`-` for null, else UTF-8 byte count, `:`, value). Leaves of a language ascend by
doc_id (null first; rows of one id by their leaf). Level by level, every FAN consecutive nodes
become their H, an incomplete run too, while more than one is left; what is left is the language's
subroot. Subroots, by language (null first, bytewise), become the root in the same way.

A level is one window over (group, parent index): its ordered full-frame collect_list, of FAN
digests at most, is the parent's preimage and holds each node's siblings; distinct parents are the
next level. Leaves are numbered within their language by a range sort and a scan, so no task holds
a language. Proofs come back from the top down: a node's proof is its own siblings and then the
proof of its parent, which FAN nodes share; so long proofs exist for parents of leaves only.

A null text, like any null field, enters as `-`; an empty one as `0:`. Very long texts are digested
whole. Rows that repeat have equal leaves at places of their own. An empty table gives no rows.
Extra columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._scan import scan
from tessera.llm._spark import discard, fold, materialise

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 3  # of so many rows, by crc32 of the id, one is tampered with

_STEP = "struct<place:int,siblings:array<string>>"


def field(value: Column) -> Column:
    """How a field enters a leaf."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a node's digest and its path: places and siblings, upwards."""
    joined = lambda d, s: F.concat(F.slice(s["siblings"], F.lit(1), s["place"]), F.array(d), F.slice(s["siblings"], s["place"] + 1, F.lit(FAN)))
    return F.aggregate(path, start, lambda d, s: F.sha2(F.array_join(joined(d, s), "").cast("binary"), 256))


def _raised(nodes: DataFrame) -> DataFrame:
    """Each node (grp, idx, digest) with its parent's index and digest, its place and siblings, and
    whether it is the only one of its group."""
    run = Window.partitionBy("grp", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = nodes.withColumn("up", F.floor(F.col("idx") / FAN).cast("long")).withColumn("run", F.collect_list("digest").over(run))
    place = (F.col("idx") % FAN).cast("int")
    siblings = F.concat(F.slice("run", F.lit(1), place), F.slice("run", place + 2, F.lit(FAN)))
    step = F.struct(place.alias("place"), siblings.alias("siblings"))
    parent = F.sha2(F.array_join("run", "").cast("binary"), 256)
    return out.select(*nodes.columns, "up", step.alias("step"), parent.alias("parent"), ((F.col("up") == 0) & (F.size("run") == 1)).alias("alone"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Written levels, from below; a group ends in the level where its node is alone."""
    levels = []
    while True:
        levels.append(materialise(_raised(nodes), "level"))
        # The first node of each run stands for the parent.
        first = levels[-1].where(~F.col("alone") & (F.col("step.place") == 0))
        nodes = first.select("grp", F.col("up").alias("idx"), F.col("parent").alias("digest"))
        if not first.limit(1).count():
            return levels


def _paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the lowest level with their `path`; paths above a group's last node, and what
    else its nodes share, are in `top` (grp, path, ...)."""
    shared = [c for c in top.columns if c != "grp"]
    kept = [c for c in levels[0].columns if c not in ("up", "step", "parent", "alone")]
    below = None
    for level in reversed(levels):
        names = kept if level is levels[0] else ["grp", "idx"]
        t, x = top.alias("t"), level.where("alone").alias("x")
        every = x.join(t, F.col("x.grp").eqNullSafe(F.col("t.grp"))).select(*(f"x.{c}" for c in names), *(f"t.{c}" for c in shared))
        if below is not None:
            x, w = level.where(~F.col("alone")).alias("x"), below.alias("w")
            under = x.join(w, F.col("x.grp").eqNullSafe(F.col("w.grp")) & (F.col("x.up") == F.col("w.idx")))
            path = F.concat(F.array("x.step"), "w.path").alias("path")
            every = every.unionByName(under.select(*(f"x.{c}" for c in names), *(path if c == "path" else F.col(f"w.{c}") for c in shared)))
        below = every
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    The rows of one id class in TAMPERED are folded from a tampered leaf: their text with A-Z in
    lower case."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = (fold("doc_id", TAMPERED) == 0) & (low != F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("grp"), leaf().alias("digest"), F.when(changed, leaf(text=low)).alias("tampered"))
    leaves = scan(rows, "grp", [F.col("doc_id").asc_nulls_first(), F.col("digest")], None, False, "number", "unused", "leaves")
    levels = _levels(leaves.select("grp", (F.col("number") - 1).alias("idx"), "digest", "doc_id", "tampered"))
    ends = reduce(DataFrame.union, [x.where("alone").select(F.lit(0).alias("all"), F.col("grp").alias("lang"), "digest") for x in levels])
    # The subroots' own tree: one group of as many nodes as there are languages.
    ranked = scan(ends, "all", [F.col("lang").asc_nulls_first()], None, False, "number", "unused", "langs")
    upper = _levels(ranked.select(F.col("all").alias("grp"), (F.col("number") - 1).alias("idx"), "digest", "lang"))
    root = reduce(DataFrame.union, [x.where("alone").select("grp", "digest") for x in upper])
    root = root.select("grp", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("digest").alias("root"))
    tops = materialise(_paths(upper, root).select(F.col("lang").alias("grp"), "path", "root", F.col("digest").alias("subroot")), "tops")
    siblings = F.flatten(F.transform("path", lambda s: s["siblings"]))
    out = _paths(levels, tops).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    out = materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    discard(leaves, *levels, ranked, *upper, tops)
    return out
