"""Running positions and sums within ordered groups, however large a group is.

Rows are sorted by range on (group, order), so a group lies in consecutive partitions, in one if it
is small. Each task scans its rows with numpy; what it must carry to the next one, the length and
the sum of the group that it ends with, is one row a partition, and only these meet in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import discard, materialise

BASE = 0x9E3779B97F4A7C15
_STATE = "_pid int, _place long, _first boolean, _local long, _sum long"


def powers(exponents: np.ndarray, base: int = BASE) -> np.ndarray:
    """Powers of an odd base modulo 2**64; negative exponents take its inverse."""
    out = np.ones(len(exponents), np.uint64)
    for sign, b in ((1, base), (-1, pow(base, -1, 2**64))):
        left = np.maximum(exponents * sign, 0)
        while left.any():
            out = np.where(left & 1, out * np.uint64(b), out)
            left, b = left >> 1, b * b % 2**64
    return out


def _changes(column: pa.Array, last: object, begun: bool) -> np.ndarray:
    """Whether each row's group differs from that of the row before."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column[1:], column[:-1]
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] = differ.to_numpy(zero_copy_only=False)
    if len(column) and begun:
        out[0] = column[0].as_py() != last
    return out


def scan(rows: DataFrame, group: str, order: list[Column], term: str | None, weighted: bool, position: str, total: str, tag: str) -> DataFrame:
    """Adds `position` (from 1, within the group, by `order`) and `total`, the sum modulo 2**64 of
    the long column `term` up to the row; if `weighted`, each term times BASE to the power of its
    position. The order must tell apart all rows that differ."""
    fields = rows.schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, begun, first, last, length, so_far = TaskContext.get().partitionId(), 0, False, True, None, 0, np.uint64(0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(group)
            head = _changes(groups, last, begun)
            starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
            goes_on = np.cumsum(head) == 0
            where = np.arange(n) - starts + np.where(goes_on, length, 0) + 1
            terms = np.zeros(n, np.uint64) if term is None else batch.column(term).to_numpy().view(np.uint64)
            if weighted:
                terms = terms * powers(where)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            sums = sums[1:] - sums[starts] + np.where(goes_on, so_far, np.uint64(0))
            firsts = goes_on & first if begun else np.cumsum(head) == 1
            first = bool(firsts[-1])
            begun, last, length, so_far = True, groups[n - 1].as_py(), int(where[-1]), sums[-1]
            state = [np.full(n, part, np.int32), place + np.arange(n), firsts, where, sums.view(np.int64)]
            place += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, state)], names=[*batch.schema.names, "_pid", "_place", "_first", "_local", "_sum"])

    made = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    made = materialise(made.mapInArrow(local, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), _STATE])), tag)
    ends = made.groupBy("_pid").agg(F.min_by(group, "_place").alias("head"), F.max_by(F.struct(F.col(group).alias("group"), "_local", "_sum"), "_place").alias("tail"))
    carried: dict[int, tuple[int, int]] = {}
    held: tuple[object, int, int] | None = None
    for r in ends.orderBy("_pid").collect():  # one row a partition
        n, s = r["tail"]["_local"], r["tail"]["_sum"] % 2**64
        at = held[1:] if held and held[0] == r["head"] else (0, 0)
        if at[0]:
            carried[r["_pid"]] = at
        if at[0] and r["tail"]["group"] == r["head"]:
            n, s = at[0] + n, (at[1] + s * (pow(BASE, at[0], 2**64) if weighted else 1)) % 2**64
        held = (r["tail"]["group"], n, s)
    kept = [f.name for f in fields]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first, where, sums = (np.asarray(batch.column(c)) for c in ("_pid", "_first", "_local", "_sum"))
            sums = sums.view(np.uint64).copy()
            where = where.copy()
            for p in np.unique(part[first]).tolist():
                if p in carried:
                    n, s = carried[p]
                    hit = (part == p) & first
                    sums[hit] = np.uint64(s) + sums[hit] * (powers(np.array([n]))[0] if weighted else np.uint64(1))
                    where[hit] += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(where), pa.array(sums.view(np.int64))], names=[*kept, position, total])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{position} long, {total} long"])
    out = materialise(made.mapInArrow(carry, shape), tag)
    discard(made)
    return out
