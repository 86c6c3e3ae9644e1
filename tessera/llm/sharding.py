"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows are numbered 0..N-1 in the order (bucket, doc_id, crc32, size), where the bucket is a hash
of id and content: numbering needs one count per bucket (a fixed number of buckets) and a sort
within each, never one global sort. A keyed Feistel network permutes the numbers; a result
outside 0..N-1 is permuted again until it falls inside (cycle walking). Row p of the permuted
order lies in shard p mod S at slot p div S, so sizes differ by one row at most, and shard and
slot of any row number, or the row number at any shard and slot, can be computed alone.

Nulls: a null id is a key of its own and sorts first; a null text has no bytes. Repeated rows
get one place each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import mix
from tessera.llm._spark import materialise

BUCKETS = 4096
ROUNDS = 8
ROW_OVERHEAD = 16


def _halves(n: int) -> tuple[np.uint64, np.uint64]:
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(ROUNDS, dtype=np.uint64), seed)


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half, mask = _halves(n)
    left, right = x >> half, x & mask
    if back:
        for key in _keys(seed)[::-1]:
            left, right = right ^ (mix(left + key) & mask), left
    else:
        for key in _keys(seed):
            left, right = right, left ^ (mix(right + key) & mask)
    return left << half | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Places of row numbers in the shuffled order of n rows; with `back`, row numbers of places."""
    out = _network(np.asarray(rows, dtype=np.uint64), n, seed, back)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = _network(out[outside], n, seed, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at one place, without a table."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(rows: DataFrame, order: list[str], into: str = "row_number") -> tuple[DataFrame, int]:
    """Adds gapless numbers from 0 in the order (hash bucket of the order columns, order columns)."""
    keyed = materialise(rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")), "rows")
    counts = dict(keyed.groupBy("_bucket").count().collect())  # one count per bucket: 4096 at most
    firsts, total = [], 0
    for bucket in range(BUCKETS):
        firsts.append(total)
        total += counts.get(bucket, 0)
    first = F.lit(firsts)[F.col("_bucket")].cast("long")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return keyed.withColumn(into, first + within - 1).drop("_bucket"), total


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = numbered.withColumn("_place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").cast("long").alias("slot"),
    )
