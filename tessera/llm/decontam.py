"""Benchmark decontamination by pigeonhole edit matching.

Words are lower-cased runs of letters, digits and non-ASCII characters. An item of n words may
differ from a passage by e = floor(n * ERROR_RATE) word edits. It is split into e + 1 pieces; a
passage within e edits holds at least one piece unchanged. Documents are searched for the hash of
the first words of every piece; around each hit, Myers' bit-parallel algorithm finds the least
edit distance between the item and any passage, which must be at most e.

Items are read in blocks of at most BLOCK_BYTES of text, counted before any block is collected and
broadcast; documents pass each block in turn, so any number of items works. Empty or null items
match nothing; null or empty documents are clean. Repeated items or rows count each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import blocks, gram_hashes, string_parts, word_hashes, word_spans
from tessera.llm._spark import fresh

ERROR_RATE = 0.125
SEED_WORDS = 6
BLOCK_BYTES = 16 << 20
_CUT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the normalised words of all texts."""
    lowered = pa.array([x.lower() if x else "" for x in texts.to_pylist()], pa.large_string())
    data, offsets = string_parts(lowered)
    starts, ends, rows = word_spans(data, offsets, _CUT)
    return word_hashes(data, starts, ends), rows


def least_distance(item: np.ndarray, passage: np.ndarray) -> int:
    """Least edit distance between the whole item and any part of the passage, in words (Myers)."""
    n = len(item)
    if not n:
        return 0
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for w in passage.tolist():
        equal = where.get(w, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        best = min(best, score)
    return best


class Pieces:
    """The pieces of a block of items, by the hash of their first words."""

    def __init__(self, ids: list[int], texts: list[str], error_rate: float) -> None:
        words, rows = hashed_words(pa.array(texts, pa.large_string()))
        limits = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.ids, self.items, self.budgets = ids, [words[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)], []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, item in enumerate(self.items):
            n = len(item)
            budget = int(n * error_rate)
            self.budgets.append(budget)
            cuts = [i * n // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    q = min(SEED_WORDS, b - a)
                    seed = int(gram_hashes(item[a : a + q], np.zeros(q, int), q)[0][0])
                    found.setdefault(q, {}).setdefault(seed, []).append((k, a))
        self.seeds = {q: (np.sort(np.array(list(by), dtype=np.uint64)), by) for q, by in found.items()}

    def search(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> list[list[int]]:
        """For each text, the ids of the items it contains."""
        out: list[set[int]] = [set() for _ in range(n_rows)]
        limits = np.searchsorted(rows, np.arange(n_rows + 1))
        tried: set[tuple[int, int, int]] = set()
        for q, (sorted_seeds, by) in self.seeds.items():
            grams, valid = gram_hashes(words, rows, q)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(sorted_seeds, grams), len(sorted_seeds) - 1)
            for p in np.flatnonzero(valid & (sorted_seeds[at] == grams)).tolist():
                row = int(rows[p])
                low, high = int(limits[row]), int(limits[row + 1])
                for k, offset in by[int(grams[p])]:
                    first = p - offset
                    if k in out[row] or (row, k, first) in tried:
                        continue
                    tried.add((row, k, first))
                    budget = self.budgets[k]
                    a, b = max(low, first - budget), min(high, first + len(self.items[k]) + budget)
                    if least_distance(self.items[k], words[a:b]) <= budget:
                        out[row].add(k)
        return [sorted(self.ids[k] for k in found) for found in out]


def find_items(docs: DataFrame, benchmark: DataFrame, into: str, text_column: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """Adds an array of the ids of the benchmark items that each document contains, in order."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).head()[0]
    n_blocks = max(1, -(-total // BLOCK_BYTES) * 2 - (total <= BLOCK_BYTES))
    out, column = docs.withColumn(into, F.array().cast("array<bigint>")), text_column
    at = out.columns.index(into)
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect() if n_blocks > 1 else items.collect()
        pieces = spark.sparkContext.broadcast(Pieces([r["item_id"] for r in rows], [r["text"] for r in rows], error_rate))

        def run(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(column)
                _, offsets = string_parts(texts)
                for a, b in blocks(offsets):
                    part = batch.slice(a, b - a)
                    words, rows = hashed_words(part.column(column))
                    found = pieces.value.search(words, rows, b - a)
                    have = part.column(at).to_pylist()
                    merged = pa.array([sorted({*x, *y}) for x, y in zip(have, found, strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], merged, *part.columns[at + 1 :]], names=part.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def flag_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and items, one row per document."""
    found = find_items(docs.select("doc_id", "text"), benchmark, "items").drop("text")
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark item, with their own columns only."""
    into = fresh(docs, "bench_items")
    return find_items(docs, benchmark, into).where(F.size(into) == 0).drop(into)
