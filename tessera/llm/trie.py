"""Prefix trie of conversations, by rolling fingerprints that are verified turn by turn.

Every conversation c is rebuilt from the first h original turns of conversation c - c % GROUP and
its own turns after its first h, h = crc32(c) % HEADS. A node is a distinct sequence of the first d
rebuilt turns; d = 0 is the root of all.

A turn is named by a hash of role and text; turns of one name are compared, role and text, with the
least one of the name, and those that differ get another name until none does. A numpy scan over the
turns, sorted by range, gives every prefix its polynomial fingerprint; those of rebuilt prefixes
follow from two of them by arithmetic, so no conversation is ever held whole. Rows of one depth and
fingerprint are a candidate node. Each row's last turn and parent are verified against those of the
representative, the least conversation; rows that differ are split off under another fingerprint,
and verifying goes on until every row agrees: then, depth by depth, whole prefixes are equal.

What a node's subtree holds is rolled up through its members: a conversation's suffix sums count,
below each of its nodes, the bytes that it repeats and the leaves that it stands for, and a node
adds its members' up. So the number of rounds does not grow with the depth of the trie. Conversations that
end in a node are sorted by range, joined in pieces, and the pieces digested in order.

Turns are ordered by `turn` (null first), equal turn numbers by the hash of what they say. A null
role or text is empty. Turns without a conv_id belong to no conversation and are left out. Very long
texts count by their hash and length; a repeated row is a turn more. An empty table gives no rows.
Extra columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import mix
from tessera.llm._scan import powers, scan
from tessera.llm._spark import discard, materialise

GROUP = 5
HEADS = 9
PIECE = 1 << 16  # bytes of joined ids in a piece


def _named(turns: DataFrame, bits: int) -> DataFrame:
    """The turns with `name`, a hash that only equal roles and texts share. bits: of the first
    hashes, fewer in tests."""
    said = F.struct("role", "text")
    named = turns.withColumn("name", F.shiftright(F.xxhash64("role", "text"), 64 - bits))
    rounds = 0
    while True:
        first = named.groupBy("name").agg(F.min(said).alias("least"), F.max(said).alias("most"))
        several = materialise(first.where("least <> most").select(F.col("name").alias("of"), "least"), "names")
        if not several.limit(1).count():
            return named
        rounds += 1
        other = F.xxhash64("name", "role", "text", F.lit(rounds))
        differ = F.coalesce(said != F.col("least"), F.lit(False))
        named = materialise(named.join(several, F.col("name") == F.col("of"), "left").withColumn("name", F.when(differ, other).otherwise(F.col("name"))).drop("of", "least"), "named")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """conv, depth, name, bytes of every rebuilt turn, and the terms of its fingerprint: those of
    the prefix up to it, `own` - `less` times BASE to the power of `shift`, and `head`."""
    heads = turns.where(F.col("number") < HEADS).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("number", "name", "bytes", "own"))).alias("heads"))
    sizes = turns.groupBy("conv").agg(F.max("number").alias("n"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    convs = materialise(heads.join(sizes, "conv").withColumn("h", h), "convs")
    base = convs.select(F.col("conv").alias("base"), F.col("heads").alias("before"))
    joined = convs.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(GROUP))).join(base, "base", "left")
    taken = F.slice(F.coalesce("before", F.array().cast(base.schema["before"].dataType)), F.lit(1), F.col("h"))
    joined = materialise(joined.select("conv", "n", "h", taken.alias("taken"), "heads"), "bases")
    zero = F.lit(0).cast("long")
    ahead = joined.select("conv", F.inline("taken")).select("conv", F.col("number").alias("depth"), "name", "bytes", "own", zero.alias("less"), zero.alias("shift"), zero.alias("head"))
    last = lambda c, size: F.coalesce(F.get(c, size - 1)["own"], zero)
    moved = joined.where("n > h").select("conv", "h", (F.size("taken") - F.col("h")).cast("long").alias("shift"), last("heads", F.col("h")).alias("less"), last("taken", F.size("taken")).alias("head"))
    behind = turns.join(moved, "conv").where("number > h").select("conv", (F.col("number") + F.col("shift")).alias("depth"), "name", "bytes", "own", "less", "shift", "head")
    return ahead.unionByName(behind)


def _fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    """conv, depth, name, bytes, key (the prefix's fingerprint) and up (that of one turn less)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(2**bits - 1)
        for batch in batches:
            own, less, head, name = (np.asarray(batch.column(c)).view(np.uint64) for c in ("own", "less", "head", "name"))
            depth, shift = (np.asarray(batch.column(c)) for c in ("depth", "shift"))
            whole = head + (own - less) * powers(shift)
            before = whole - mix(name) * powers(depth)
            made = [pa.array((mix(x) & mask).view(np.int64)) for x in (whole, before)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "depth", "name", "bytes")), *made], names=["conv", "depth", "name", "bytes", "key", "up"])

    return rows.mapInArrow(run, "conv long, depth long, name long, bytes long, key long, up long")


def _verified(rows: DataFrame) -> DataFrame:
    """The rows with collisions split: of one depth and key, all have one parent and one last turn."""
    seen = F.struct("up", "name")
    rounds = 0
    while True:
        found = rows.groupBy("depth", "key").agg(F.min(seen).alias("least"), F.max(seen).alias("most"), F.min_by(seen, "conv").alias("of_first"))
        several = materialise(found.where("least <> most").select("depth", "key", "of_first"), "collisions")
        if not several.limit(1).count():
            return rows
        rounds += 1
        other = F.xxhash64("key", "up", "name", F.lit(rounds))
        marked = rows.join(several, ["depth", "key"], "left")
        marked = marked.withColumn("new", F.when(F.coalesce(F.struct("up", "name") != F.col("of_first"), F.lit(False)), other).otherwise(F.col("key")))
        marked = materialise(marked.select(*rows.columns, "new"), "split")
        # Rows below one that was split off have a new parent.
        moved = marked.where("new <> key").select("conv", (F.col("depth") + 1).alias("depth"), F.col("new").alias("new_up"))
        rows = marked.join(moved, ["conv", "depth"], "left").select("conv", "depth", "name", "bytes", F.col("new").alias("key"), F.coalesce("new_up", "up").alias("up"))
        rows = materialise(rows, "rows")


def _pieces(ends: DataFrame) -> DataFrame:
    """depth, key and place of pieces of the comma-joined, sorted ids (conv) that end in a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, node, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            made = []
            for depth, key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "conv")), strict=True):
                if held and (node != (depth, key) or size >= PIECE):
                    made.append((*node, part, number, ",".join(held)))
                    number, held, size = number + 1, [], 0
                node = (depth, key)
                held.append(str(conv))
                size += len(held[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["depth", "key", "part", "number", "piece"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, part, number, ",".join(held))], names=["depth", "key", "part", "number", "piece"])

    ordered = ends.repartitionByRange("depth", "key", "conv").sortWithinPartitions("depth", "key", "conv")
    return ordered.mapInArrow(run, "depth long, key long, part long, number long, piece string")


def _digests(ends: DataFrame) -> DataFrame:
    """depth, key and ends_sha256 of the nodes in which conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            made = []
            for depth, key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "piece")), strict=True):
                if node == (depth, key):
                    digest.update(b",")
                else:
                    if node:
                        made.append((*node, digest.hexdigest()))
                    node, digest = (depth, key), hashlib.sha256()
                digest.update(piece.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["depth", "key", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["depth", "key", "ends_sha256"])

    pieces = materialise(_pieces(ends), "pieces")
    ordered = pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "part", "number")
    return ordered.mapInArrow(run, "depth long, key long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, name_bits: int = 64, key_bits: int = 64) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of
    every node. name_bits, key_bits: of the hashes that group candidates; fewer make collisions,
    which cost rounds but change nothing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = _named(turns, name_bits).select("conv", "turn", "name", F.octet_length("text").cast("long").alias("bytes"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = mix(np.asarray(batch.column("name")).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(term)], names=[*batch.schema.names, "term"])

    turns = turns.mapInArrow(weigh, "conv long, turn long, name long, bytes long, term long")
    turns = scan(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("name"), F.col("bytes")], "term", True, "number", "own", "turns")
    rows = materialise(_fingerprints(_rebuilt(turns), key_bits), "prefixes")
    zero = F.lit(0).cast("long")
    root = turns.select("conv").distinct().select("conv", zero.alias("depth"), zero.alias("name"), zero.alias("bytes"), zero.alias("key"), zero.alias("up"))
    # The parent of a first turn is the root, whatever an empty prefix's fingerprint is.
    rows = _verified(rows.withColumn("up", F.when(F.col("depth") == 1, 0).otherwise(F.col("up")))).unionByName(root)
    nodes = rows.groupBy("depth", "key").agg(F.min("conv").alias("first"), F.count("*").alias("n_convs"), F.any_value("up").alias("up"))
    nodes = materialise(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    families = materialise(nodes.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "families")
    # A conversation repeats the bytes of the nodes that it is not the first of, and stands for the leaf that it is the first of.
    own = families.select("depth", "key", "first", "n_children")
    marked = rows.join(own, ["depth", "key"])
    is_first = F.col("conv") == F.col("first")
    marked = marked.select("conv", "depth", "key", F.when(is_first, 0).otherwise(F.col("bytes")).alias("repeated"), (is_first & (F.col("n_children") == 0)).cast("long").alias("leaf"))
    suffixes = scan(marked, "conv", [F.col("depth").desc()], "repeated", False, "from_end", "saved", "suffixes")
    # Only a conversation's last node can be a leaf.
    leaves = suffixes.where("leaf = 1").select("conv", "leaf")
    stands = suffixes.select("conv", "depth", "key", "saved").join(leaves, "conv", "left")
    stands = materialise(stands.withColumn("leaf", F.coalesce("leaf", zero)), "stands")
    sums = stands.groupBy("depth", "key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    digests = _digests(suffixes.where("from_end = 1").select("depth", "key", "conv"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("first").alias("parent_conv_id"))
    whole = families.join(sums, ["depth", "key"]).join(digests, ["depth", "key"], "left")
    whole = materialise(whole, "summed").join(parents, ["depth", "up"], "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    out = whole.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    out = materialise(out, "trie")
    discard(turns, nodes, families, suffixes, stands)
    return out
