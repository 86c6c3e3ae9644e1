"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed random rotation. Two of them have a cosine
of SIMILARITY or more if their squared distance is at most 2 - 2 * SIMILARITY; split into BLOCKS
blocks of coordinates, at least one block of such a pair has no more than its share, by dimensions,
of this budget. So each block is range-joined under its share, and the union of what it finds is
verified by the cosine of whole vectors, in double precision: no link is lost, none is wrong.

Range join of a block: vectors are sorted by their sides of the means into cells of about CELL vectors at most,
each one row of a table. Every pair of cells meets in one task, in a nested loop of that table with itself, so no vector
is written more than once, however many cells it reaches. Vectors of one cell that are farther than the block's share of the budget
from the box that holds the other one are left out; products of the block decide about the rest. A pair that several
blocks find is counted in the first of them alone, so pairs are counted where they are found and
none is ever written.

Groups of copies are balls: equal vectors are one node from the start; then, in one round a block,
nodes that lie on the same side of the mean in all coordinates of the block meet the heaviest one
among them, and those within RADIUS of it become its members. Members of one ball are all linked.
Two balls are compared by their centres: they are linked as a whole, or not at all, or, if the
distance leaves it open, member by member, in chunks of at most about CHUNK. So a group of n copies costs about n
rows and no pair of them is looked at.

Null and zero vectors, and those that hold null or non-finite components, link with nothing; each
is a component of its own. A shorter vector counts as filled up with zeros. Null ids sort last.
Repeated rows are equal vectors like any others. An empty table gives no rows. Extra columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import discard, materialise
from tessera.llm.components import components

SIMILARITY = 0.9
BLOCKS = 4
CELL = 8192
CHUNK = 8192
LEAST_CELL = 1024
RADIUS = 0.2
_LINK = float(np.sqrt(2 - 2 * SIMILARITY))
_SLACK = 1e-9
_ROUGH = 2e-5  # more than single precision errs in a squared distance
_SLICE = 512
_PAIRS = 1 << 16
_NODE = "node long, weight long, radius double, unit binary"
_FINDING = "kind int, a long, b long"
assert 2 * RADIUS < _LINK, "members of one ball must be linked"


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def spans(d: int) -> list[tuple[int, int]]:
    """Limits of the blocks."""
    cuts = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def units(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors of length one, and which rows have one."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), d))
    out[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = values
    with np.errstate(all="ignore"):
        most = np.abs(out).max(axis=1, initial=0)
        good = np.isfinite(most) & (most > 0)
        scaled = out[good] / most[good, None]
    scaled = scaled @ rotation(d)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None], good


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), d)


def _packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(matrix, "<f8")], pa.binary())


# Balls


def _means(nodes: DataFrame, d: int) -> np.ndarray:
    """Mean of each rotated coordinate; a task sends one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d), 0
        for batch in batches:
            total, n = total + _matrix(batch.column("unit"), d).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, n))], names=["at", "total", "n"])

    sums = nodes.select("unit").mapInArrow(run, "at long, total double, n long").groupBy("at").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    return np.array([r["mean"] for r in sums.orderBy("at").collect()])


def _absorbed(nodes: DataFrame, span: tuple[int, int], means: np.ndarray, d: int) -> DataFrame:
    """node, ball, reach and weight of single nodes that join the ball of the heaviest node on their side
    of the means."""
    a, b = span

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.packbits(_matrix(batch.column("unit"), d)[:, a:b] > means[a:b], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in side], pa.binary())], names=[*batch.schema.names, "side"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _matrix(batch.column("unit"), d) - _matrix(batch.column("centre"), d)
            reach = np.sqrt((far * far).sum(axis=1))
            kept = pa.array(reach <= RADIUS)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("node", "ball")] + [pa.array(reach[reach <= RADIUS]), batch.column("weight").filter(kept)], names=["node", "ball", "reach", "weight"])

    coded = nodes.mapInArrow(sides, _NODE + ", side binary")
    heaviest = F.max_by(F.struct("node", "unit"), F.struct("weight", F.xxhash64("node"))).alias("lead")
    leads = coded.groupBy("side").agg(heaviest, F.count("*").alias("n")).where("n > 1").select("side", F.col("lead.node").alias("ball"), F.col("lead.unit").alias("centre"))
    met = coded.where("radius = 0").join(leads, "side").where("node <> ball").select("node", "unit", "weight", "ball", "centre")
    return materialise(met.mapInArrow(near, "node long, ball long, reach double, weight long"), "absorbed")


def _balls(nodes: DataFrame, means: np.ndarray, d: int) -> tuple[DataFrame, DataFrame]:
    """The nodes that are left, with the weight and radius of their balls; and (node, ball) of those
    that joined one."""
    members, old = None, []
    for span in spans(d):
        absorbed = _absorbed(nodes, span, means, d)
        sums = absorbed.groupBy("ball").agg(F.sum("weight").alias("more"), F.max("reach").alias("reach"))
        left = nodes.join(absorbed.select("node"), "node", "left_anti").join(sums, F.col("node") == F.col("ball"), "left")
        left = left.select("node", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), F.greatest("radius", F.coalesce("reach", F.lit(0.0))).alias("radius"), "unit")
        old.append(nodes)
        nodes = materialise(left, "balls")
        joined = absorbed.select("node", "ball")
        members = joined if members is None else members.union(joined)
    discard(*old[1:])
    return nodes, members


# Comparing


class _Side:
    """Nodes to be compared: ids, weights, radii and units, and their single nodes and balls apart."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, radii: np.ndarray, unit: np.ndarray):
        self.ids, self.weights, self.radii, self.unit = ids, weights, radii, unit
        self.parts = [x for x in (np.flatnonzero(radii == 0), np.flatnonzero(radii > 0)) if len(x)]
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def columns(self, part: int, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A part's coordinates of a block, to be multiplied with, and the limits of the box that holds them."""
        key = (part, span[0])
        if key not in self.held:
            v = self.unit[self.parts[part], span[0] : span[1]]
            self.held[key] = np.column_stack([v, np.ones(len(v)), -0.5 * (v * v).sum(axis=1)]).astype(np.float32), v.min(axis=0), v.max(axis=0)
        return self.held[key]


def _near(x: _Side, y: _Side, block: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may be within the block's share of their budget, and of some more; of
    all pairs that may be linked if there is no block. In single precision: the sum of products of two vectors, each
    with half its square, is minus half their squared distance."""
    found = []
    for i in x.parts:
        for part, j in enumerate(y.parts):
            if block < 0:
                hits = np.nonzero(x.unit[i] @ y.unit[j].T >= SIMILARITY - _SLACK)
                found.append((i[hits[0]], j[hits[1]]))
                continue
            a, b = spans(d)[block]
            limit = (_LINK + x.radii[i].max() + y.radii[j].max()) ** 2 * ((b - a) / d) + _ROUGH
            right, low, high = y.columns(part, (a, b))
            u = x.unit[i, a:b]
            beyond = np.maximum(low - u, 0) + np.maximum(u - high, 0)
            reach = (beyond * beyond).sum(axis=1) <= limit
            u, those = u[reach], i[reach]
            left = np.column_stack([u, -0.5 * (u * u).sum(axis=1), np.ones(len(u))]).astype(np.float32)
            hits = np.nonzero(left @ right.T >= np.float32(-limit / 2))
            found.append((those[hits[0]], j[hits[1]]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


class _Bucket:
    """Stored nodes and what has been found of them. block -1: whole vectors are compared, and every pair counts."""

    def __init__(self, d: int):
        self.block, self.d, self.parts, self.ready = -1, d, [], False

    def store(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def hold(self, own: _Side) -> None:
        self.own, self.ids, self.ready = own, own.ids, True
        self.sums, self.roots = np.zeros(len(self.ids), np.int64), list(range(len(self.ids)))

    def find(self, i: int) -> int:
        while self.roots[i] != i:
            self.roots[i] = self.roots[self.roots[i]]
            i = self.roots[i]
        return i

    def compare(self, probes: _Side, first: int | None = None) -> list[tuple[int, int, int]]:
        """Findings (kind, a, b): 0: b rows are linked to node a; 1: a and b are linked; 2: undecided.
        first: place of the first probe if the probes are stored nodes; those meet later ones only."""
        rows, columns = _near(probes, self.own, self.block, self.d)
        if first is not None:
            later = columns > rows + first
            rows, columns = rows[later], columns[later]
        out: list[tuple[int, int, int]] = []
        for k in range(0, len(rows), _PAIRS):
            out += self.judge(probes, rows[k : k + _PAIRS], columns[k : k + _PAIRS], first)
        return out

    def judge(self, probes: _Side, rows: np.ndarray, columns: np.ndarray, first: int | None) -> list[tuple[int, int, int]]:
        """Exact, and alike in every block's task: the pair counts in the first block that finds it."""
        x, y = probes.unit[rows], self.own.unit[columns]
        wide = probes.radii[rows] + self.own.radii[columns]
        if self.block >= 0:
            far = x - y
            cuts = spans(self.d)
            squares = np.add.reduceat(far * far, [a for a, _ in cuts], axis=1)
            inside = squares <= ((wide + _LINK) ** 2)[:, None] * (np.array([b - a for a, b in cuts]) / self.d) + _SLACK
            counts = inside[:, self.block] & ~inside[:, : self.block].any(axis=1)
        else:
            counts = np.ones(len(rows), bool)
        cosines = (x * y).sum(axis=1)
        distance = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        linked = counts & np.where(wide == 0, cosines >= SIMILARITY, distance + wide <= _LINK - _SLACK)
        unsure = counts & ~linked & (wide > 0) & (distance - wide <= _LINK + _SLACK)
        out = [(2, a, b) for a, b in zip(probes.ids[rows[unsure]].tolist(), self.ids[columns[unsure]].tolist(), strict=True)]
        rows, columns = rows[linked], columns[linked]
        if not len(rows):
            return out
        add = lambda at, weights, n: np.bincount(at, weights, n).astype(np.int64)  # noqa: E731  exact below 2**53
        self.sums += add(columns, probes.weights[rows], len(self.ids))
        found = add(rows, self.own.weights[columns], len(probes.ids))
        if first is not None:
            self.sums[first : first + len(found)] += found
            pairs = np.stack([rows + first, columns], axis=1)
        else:
            hit, at = np.unique(rows, return_index=True)
            out += [(0, a, n) for a, n in zip(probes.ids[hit].tolist(), found[hit].tolist(), strict=True)]
            out += [(1, a, b) for a, b in zip(probes.ids[hit].tolist(), self.ids[columns[at]].tolist(), strict=True)]
            pairs = np.stack([columns[at][np.searchsorted(hit, rows)], columns], axis=1)
        for i, j in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist():
            i, j = self.find(i), self.find(j)
            self.roots[max(i, j)] = min(i, j)
        return out

    def finish(self) -> list[tuple[int, int, int]]:
        if not self.ready:
            return []
        hit = np.flatnonzero(self.sums)
        out = [(0, a, n) for a, n in zip(self.ids[hit].tolist(), self.sums[hit].tolist(), strict=True)]
        return out + [(1, int(self.ids[i]), int(self.ids[r])) for i in range(len(self.ids)) if (r := self.find(i)) != i]


def _columns(rows: pa.Table | pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.asarray(rows.column(c)) for c in ("node", "weight", "radius")), _matrix(rows.column("unit"), d))


def _compared(rows: DataFrame, d: int) -> DataFrame:
    """Findings (kind, a, b) of buckets. rows: bucket, part, probe (false: stored), and a node.
    Stored nodes of a bucket come first, probes stream past them; stored nodes are not compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "part", "probe")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                *now, probe = keys[a].tolist()
                if now != key:
                    if bucket:
                        out += bucket.finish()
                    key, bucket = now, _Bucket(d)
                part = batch.slice(a, b - a)
                if not probe:
                    bucket.store(part)
                elif bucket.parts:
                    if not bucket.ready:
                        bucket.hold(_Side(*_columns(pa.Table.from_batches(bucket.parts).combine_chunks(), d)))
                    for i in range(0, part.num_rows, _SLICE):
                        out += bucket.compare(_Side(*_columns(part.slice(i, _SLICE), d)))
                else:
                    key, bucket = now, None
            if out:
                yield _findings(out)
        if bucket and (out := bucket.finish()):
            yield _findings(out)

    ordered = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "probe")
    return materialise(ordered.mapInArrow(run, _FINDING), "findings")


def _findings(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kind, a, b = np.array(out, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _cells(nodes: DataFrame, means: np.ndarray, d: int) -> DataFrame:
    """The nodes in cells, one row each, sorted by their sides of the means: of the first coordinates of all blocks, then of the second ones."""
    n = nodes.count()
    size = max(1, min(CELL, max(LEAST_CELL, -(-n // 8))))
    order = [a + i for i in range(d) for a, b in spans(d) if a + i < b]

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.packbits((_matrix(batch.column("unit"), d) > means)[:, order], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in side], pa.binary())], names=[*batch.schema.names, "side"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            while held + batch.num_rows > 2 * CELL:  # no cell is larger, however even the ranges are
                parts.append(batch.slice(0, 2 * CELL - held))
                batch = batch.slice(2 * CELL - held)
                yield row(parts)
                parts, held = [], 0
            parts.append(batch)
            held += batch.num_rows
        if held:
            yield row(parts)

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = [b"".join(np.asarray(p.column(c), t).tobytes() for p in parts) for c, t in (("node", "<i8"), ("weight", "<i8"), ("radius", "<f8"))]
        made.append(b"".join(x for p in parts for x in p.column("unit").to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=["nodes", "weights", "radii", "units"])

    ranged = nodes.mapInArrow(sided, _NODE + ", side binary").repartitionByRange(max(1, -(-n // size)), "side", "node")
    cells = ranged.select("node", "weight", "radius", "unit").mapInArrow(packed, "nodes binary, weights binary, radii binary, units binary")
    return materialise(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")


def _met(cells: DataFrame, d: int) -> DataFrame:
    """Findings (kind, a, b) of all pairs of cells, each in one order, and of each cell with itself."""
    x, y = (cells.select(*(F.col(c).alias(f"{c}_{side}") for c in cells.columns)) for side in "xy")
    one_way = (F.pmod(F.xxhash64(F.least("cell_x", "cell_y"), F.greatest("cell_x", "cell_y")), F.lit(2)) == 0) == (F.col("cell_x") < F.col("cell_y"))
    pairs = x.join(y, (F.col("cell_x") == F.col("cell_y")) | one_way)

    def side(batch: pa.RecordBatch, i: int, of: str) -> _Side:
        ids, weights, radii, unit = (np.frombuffer(batch.column(f"{c}_{of}")[i].as_buffer(), t) for c, t in (("nodes", "<i8"), ("weights", "<i8"), ("radii", "<f8"), ("units", "<f8")))
        return _Side(ids, weights, radii, unit.reshape(len(ids), d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                probes, bucket = side(batch, i, "x"), _Bucket(d)
                bucket.hold(side(batch, i, "y"))
                same, out = batch.column("cell_x")[i] == batch.column("cell_y")[i], []
                for at in range(0, len(probes.ids), _SLICE):
                    cut = slice(at, at + _SLICE)
                    some = _Side(probes.ids[cut], probes.weights[cut], probes.radii[cut], probes.unit[cut])
                    for bucket.block in range(len(spans(d))):
                        out += bucket.compare(some, at if same else None)
                if out := out + bucket.finish():
                    yield _findings(out)

    return materialise(pairs.mapInArrow(run, _FINDING), "findings")


def _opened(unsure: DataFrame, balls: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets of undecided pairs of balls: the members of the heavier one, in chunks, are stored, and
    those of all its partners are probes."""
    sizes = balls.select("node", "weight")
    x, y = sizes.select(F.col("node").alias("a"), F.col("weight").alias("w_a")), sizes.select(F.col("node").alias("b"), F.col("weight").alias("w_b"))
    both = unsure.select("a", "b").join(x, "a").join(y, "b")
    more = F.struct("w_a", "a") > F.struct("w_b", "b")
    pairs = materialise(both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("small")).distinct(), "unsure")
    inside = members.union(balls.select("node", F.col("node").alias("ball")))
    wanted = pairs.select(F.col("big").alias("ball")).union(pairs.select(F.col("small").alias("ball"))).distinct()
    held = materialise(inside.join(wanted, "ball").join(nodes.select("node", "weight", "unit"), "node").select("ball", "node", "weight", F.lit(0.0).alias("radius"), "unit"), "opened")
    counts = materialise(held.groupBy("ball").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")), "chunks")
    big = pairs.select(F.col("big").alias("ball")).distinct().join(counts, "ball")
    stored = held.join(big, "ball").select(F.col("ball").alias("bucket"), F.pmod(F.xxhash64("node"), "chunks").alias("part"), F.lit(False).alias("probe"), "node", "weight", "radius", "unit")
    asked = pairs.join(counts.withColumnRenamed("ball", "big"), "big").select("big", F.col("small").alias("ball"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"))
    probes = held.join(asked, "ball").select(F.col("big").alias("bucket"), "part", F.lit(True).alias("probe"), "node", "weight", "radius", "unit")
    return stored.unionByName(probes)


def link_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other rows with a cosine of SIMILARITY or more), component_id (the least id
    that links lead to) and kept (whether that is its own) of every row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    d = rows.agg(F.max(F.size("v"))).head()[0] or 0
    d = max(1, d)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                unit, good = units(part.column("v"), d)
                made: list[bytes | None] = [None] * part.num_rows
                for at, x in zip(np.flatnonzero(good).tolist(), unit.astype("<f8"), strict=True):
                    made[at] = x.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(made, pa.binary())], names=["vec_id", "unit"])

    scaled_rows = materialise(rows.mapInArrow(scaled, "vec_id long, unit binary"), "units")
    distinct = scaled_rows.where("unit IS NOT NULL").groupBy("unit").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    whole = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = whole.select("node", "weight", F.lit(0.0).alias("radius"), "unit")
    means = _means(nodes, d)
    balls, members = _balls(nodes, means, d)
    cells = _cells(balls, means, d)
    found = _met(cells, d)
    discard(cells)
    unsure = found.where("kind = 2")
    opened = _compared(_opened(unsure, balls, members, nodes), d)
    inner = members.select(F.col("node").alias("a"), F.col("ball").alias("b"))
    edges = found.unionByName(opened).where("kind = 1").select("a", "b").union(inner)
    labels = components(edges)
    # Rows linked to a node: those of its own ball, of balls linked as a whole, and single ones.
    whole_balls = found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("b").alias("linked"))
    single = opened.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("more"))
    of = whole.join(members, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    named = balls.select(F.col("node").alias("ball"), F.col("weight").alias("inside"))
    of = of.join(named, "ball").join(whole_balls, "ball", "left").join(single, "node", "left").join(labels, "node", "left")
    zero = F.lit(0).cast("long")
    judged = materialise(of.select("unit", "vec_id", (F.col("inside") - 1 + F.coalesce("linked", zero) + F.coalesce("more", zero)).alias("n_links"), F.coalesce("label", "node").alias("label")), "judged")
    least = judged.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    known = materialise(judged.join(least, "label").select("unit", "n_links", "component_id"), "classes")
    out = scaled_rows.join(known, "unit", "left")
    out = out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = materialise(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "links")
    discard(scaled_rows, whole, balls, found, opened, labels, judged, known)
    return out
