"""Exemplars alike to texts, exactly, and a store of exemplars that are not alike among themselves.

Likeness is difflib's ratio of two normalised texts, as they are given. The exemplars are a
stated query set, held in blocks of about BLOCK exemplars or CHARACTERS of them, against all texts. Three bounds rule out pairs before
the ratio is taken, each at most the one before it and none below the ratio: lengths; the characters
that both have, in 64 classes; and their longest common subsequence, by bits of whole numbers, of which one
holds GROUP exemplars side by side, so a text goes through them all at once, and stops when the rest of it
cannot bring any up to what is asked for. So no pair is lost.

Texts that are too short or too long for any exemplar go before they are shuffled.

Null texts are like nothing; empty ones only like empty ones. Equal texts of many rows are compared once.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import first_rows
from tessera.sources.work import work_dir

HEAD = 300
BLOCK = 20_000
CHARACTERS = 6_000_000
CLASSES = 64
STEP = 32
GROUP = 64
# What an exemplar must score, how alike two may be, how many are kept, how alike a text must be.
MIN_SCORE, TOO_ALIKE, MOST, ALIKE = 9.0, 0.90, 200, 0.75


def normalised(text: Column) -> Column:
    """The whole text with single spaces, none at the ends, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")))


def head(text: Column) -> Column:
    """HEAD characters of a normalised text."""
    return F.left(normalised(text), F.lit(HEAD))


def classes(text: str) -> np.ndarray:
    """How many characters of each class a text has. Classes only make texts look more alike."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES, minlength=CLASSES).astype(np.int32)


def places(text: str) -> dict[str, int]:
    """Bits of the places at which each character stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(at: dict[str, int], n: int, other: str, least: float) -> int:
    """Longest common subsequence of a text of n characters, by their places, and another, if it may be `least`; else some smaller bound."""
    every = (1 << n) - 1
    rest, left = every, len(other)
    for k in range(0, len(other), STEP):
        for c in other[k : k + STEP]:
            hit = rest & at.get(c, 0)
            rest = (rest + hit) | (rest - hit)
        left -= STEP
        rest &= every
        if n - rest.bit_count() + max(left, 0) < least:
            return n - rest.bit_count() + max(left, 0)
    return n - rest.bit_count()


class Group:
    """Exemplars side by side in whole numbers, each in a field of whole bytes with a bit to carry into."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.bytes = int(self.sizes.max()) // 8 + 1
        self.at: dict[str, int] = {}
        self.every = 0
        for i, t in enumerate(texts):
            shift = 8 * self.bytes * i
            self.every |= ((1 << len(t)) - 1) << shift
            for c, bits in places(t).items():
                self.at[c] = self.at.get(c, 0) | bits << shift

    def common(self, other: str, least: np.ndarray) -> np.ndarray:
        """As `common`, of each exemplar; some smaller bounds if none may reach its `least`."""
        every = rest = self.every
        for k in range(0, max(1, len(other)), STEP):
            for c in other[k : k + STEP]:
                at = self.at.get(c)
                if at is not None:
                    hit = rest & at
                    rest = ((rest + hit) | (rest - hit)) & every
            held = np.frombuffer(rest.to_bytes(self.bytes * len(self.sizes), "little"), np.uint8).reshape(-1, self.bytes)
            most = self.sizes - np.bitwise_count(held).sum(axis=1, dtype=np.int64) + max(len(other) - k - STEP, 0)
            if (most < least).all():
                break
        return most


class Exemplars:
    """A block of exemplars, ready to be compared: by length, so those of a group are ruled out together."""

    def __init__(self, ids: list[int], texts: list[str]):
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.classes = np.stack([classes(t) for t in self.texts]) if texts else np.zeros((0, CLASSES), np.int32)
        self.groups = [Group(self.texts[k : k + GROUP]) for k in range(0, len(texts), GROUP)]

    def alike(self, text: str, least: float) -> list[tuple[int, float]]:
        """(id, likeness) of all exemplars at `least` or more."""
        total = self.sizes + len(text)
        may = np.flatnonzero(2 * np.minimum(self.sizes, len(text)) >= least * total)
        if not len(may):
            return []
        may = may[2 * np.minimum(self.classes[may], classes(text)).sum(axis=1, dtype=np.int64) >= least * total[may]]
        out = []
        for g in np.unique(may // GROUP).tolist():
            mine = may[may // GROUP == g]
            # Those ruled out already can reach nothing.
            wanted = np.full(len(self.groups[g].sizes), np.inf)
            wanted[mine - g * GROUP] = least * total[mine] / 2
            near = self.groups[g].common(text, wanted)[mine - g * GROUP]
            for i in mine[2 * near >= least * total[mine]].tolist():
                ratio = difflib.SequenceMatcher(None, text, self.texts[i]).ratio()
                if ratio >= least:
                    out.append((self.ids[i], ratio))
        return out


def alike(texts: DataFrame, exemplars: DataFrame, least: float) -> DataFrame:
    """text_id, exemplar_id and likeness of all pairs at `least` or more. Both tables: id (long), t (normalised)."""
    size = F.length("t")
    held = exemplars.agg(F.count("*").alias("n"), F.sum(size).alias("all"), F.min(size).alias("least"), F.max(size).alias("most")).head()
    blocks = max(1, -(-held["n"] // BLOCK), -(-(held["all"] or 0) // CHARACTERS))
    # Twice the shorter is no less than `least` of both; one character more than that is left in.
    texts = texts.where((size * (2 - least) >= least * ((held["least"] or 0) - 1)) & (size * least <= (2 - least) * ((held["most"] or 0) + 1)))
    distinct = texts.groupBy("t").agg(F.min("id").alias("first"))
    found = None
    for k in range(blocks):
        block = exemplars.where("t IS NOT NULL").where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").collect()
        ids, words = [r["id"] for r in block], [r["t"] for r in block]

        def run(batches: Iterator[pa.RecordBatch], ids: list[int] = ids, words: list[str] = words) -> Iterator[pa.RecordBatch]:
            held = Exemplars(ids, words)
            for batch in batches:
                made = [(first, i, ratio) for first, t in zip(batch.column("first").to_pylist(), batch.column("t").to_pylist(), strict=True) for i, ratio in held.alike(t, least)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["first", "exemplar_id", "likeness"])

        part = distinct.repartition("t").select("first", "t").mapInArrow(run, "first long, exemplar_id long, likeness double")
        found = part if found is None else found.union(part)
    named = texts.join(distinct, "t").select(F.col("id").alias("text_id"), "first")
    return found.join(named, "first").select("text_id", "exemplar_id", "likeness")


def lookup(texts: DataFrame, exemplars: DataFrame, most: int = 3, least: float = ALIKE) -> DataFrame:
    """The exemplars most alike to each text of their kind. Both tables: id, kind, t."""
    pairs = alike(texts.select("id", "t"), exemplars.select("id", "t"), least)
    kinds = exemplars.select(F.col("id").alias("exemplar_id"), F.col("kind").alias("of"))
    same = pairs.join(texts.select(F.col("id").alias("text_id"), "kind"), "text_id").join(kinds, "exemplar_id").where(F.col("kind").eqNullSafe(F.col("of")))
    return first_rows(same, ["text_id"], [F.desc("likeness"), F.asc("exemplar_id")], most).select("text_id", "exemplar_id", "likeness")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (id, place) that a walk in the order of their places keeps, if it leaves out each
    one that has an edge (a, b) to one that it kept. In rounds: a node with no open neighbour before it is kept, and
    its neighbours go. Written after each round, so a lost executor costs one."""
    spark = nodes.sparkSession
    folder = work_dir(spark, "independent")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    links = written(both.join(nodes.select(F.col("id").alias("a"), F.col("place").alias("place_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("place").alias("place_b")), "b"), "links")
    left, kept, number = written(nodes.select("id", "place"), "left"), [], 0
    while left.limit(1).count():
        number += 1
        blocked = links.where("place_b < place_a").select(F.col("a").alias("id")).distinct()
        free = written(left.join(blocked, "id", "left_anti"), f"kept{number}")
        kept.append(free)
        gone = written(links.join(free.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct(), f"gone{number}")
        done = gone.union(free.select("id"))
        left = written(left.join(done, "id", "left_anti"), f"left{number}")
        links = written(links.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti"), f"links{number}")
    return reduce(DataFrame.union, kept) if kept else left


def stored(candidates: DataFrame, most: int = MOST, block: int = 1000) -> DataFrame:
    """The exemplars that a store keeps if it is offered candidates (id, score, t) best first (ties by
    id): those of MIN_SCORE and more that are not too like one kept before, `most` at most.

    The store is full after `most`, so candidates are taken in blocks until it is; a block is compared
    with itself and with what is kept. Only ids of blocks pass the driver."""
    good = candidates.where((F.col("score") >= MIN_SCORE) & F.col("t").isNotNull() & (F.col("t") != "")).select("id", "score", "t")
    folder = work_dir(candidates.sparkSession, "candidates")
    good.write.parquet(folder)  # scored once, however many blocks are taken
    good = candidates.sparkSession.read.schema(good.schema).parquet(folder)
    kept: list = []
    last = None
    while len(kept) < most:
        ahead = good if last is None else good.where((F.col("score") < last[0]) | ((F.col("score") == last[0]) & (F.col("id") > last[1])))
        rows = ahead.orderBy(F.desc("score"), "id").limit(block).collect()
        if not rows:
            break
        last = (rows[-1]["score"], rows[-1]["id"])
        spark = candidates.sparkSession
        now = spark.createDataFrame([(r["id"], r["t"], place) for place, r in enumerate(rows)], "id long, t string, place long")
        before = spark.createDataFrame([(r["id"], r["t"]) for r in kept], "id long, t string")
        strictly = F.col("likeness") > TOO_ALIKE
        if kept:
            near = alike(now.select("id", "t"), before, TOO_ALIKE).where(strictly).select(F.col("text_id").alias("id")).distinct()
            now = now.join(near, "id", "left_anti")
        # A later candidate is compared with an earlier one, in this order: difflib's ratio depends on it.
        edges = alike(now.select("id", "t"), now.select("id", "t"), TOO_ALIKE).where(strictly)
        places = now.select("id", "place")
        x, y = places.select(F.col("id").alias("text_id"), F.col("place").alias("p")), places.select(F.col("id").alias("exemplar_id"), F.col("place").alias("q"))
        edges = edges.join(x, "text_id").join(y, "exemplar_id").where("p > q").select(F.col("text_id").alias("a"), F.col("exemplar_id").alias("b"))
        chosen = {r["id"] for r in first_independent(places, edges).select("id").collect()}
        kept += [r for r in rows if r["id"] in chosen][: most - len(kept)]
    return candidates.sparkSession.createDataFrame([(r["id"], float(r["score"]), r["t"], i + 1) for i, r in enumerate(kept)], "id long, score double, t string, place long")
