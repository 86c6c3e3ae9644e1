"""Terms that texts contain, whatever the case: one path for glossaries of any size.

Each term is known by a run of its bytes, of the length of the largest class in SIZES that it has: the
one that the fewest terms have. A text looks its runs up in a bitmap of fixed size that holds those
that terms are known by, and sends on only what it finds there; pairs of a text and a term then meet
the text, once, by its id, and `contains` decides. A glossary that fills the bitmap costs time, but
nothing is lost. Null and empty terms are contained in nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (8, 3, 1)
BITS = 20  # of the places in the bitmap
_CHUNK = 1 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a megabyte."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        yield at, to
        at = to


def _runs(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of so many bytes, and their rows. The keys are different for different runs of one size."""
    n = max(len(data) - size + 1, 0)
    keys = np.full(n, size, np.uint64) if size < 8 else np.zeros(n, np.uint64)
    for j in range(size):
        keys = (keys << np.uint64(8)) | data[j : n + j]
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = rows[:n] == rows[size - 1 :]
    return keys[inside], rows[:n][inside]


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _term_runs(terms: DataFrame, bits: int) -> DataFrame:
    """term and run, for all runs of a term of its own class; place: of the run in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("term"))
            for a, b in _chunks(offsets):
                some, limits = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                length = np.diff(limits)
                for above, size in zip((1 << 62, *SIZES), SIZES, strict=False):
                    keys, rows = _runs(some, limits, size)
                    mine = (length[rows] >= size) & (length[rows] < above)
                    keys, rows = keys[mine], rows[mine]
                    yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(rows + a)), pa.array(keys.view(np.int64)), pa.array(_places(keys, bits).astype(np.int32))], names=["term", "run", "place"])

    return terms.mapInArrow(run, "term string, run long, place int").distinct()


def _text_runs(low: DataFrame, known: np.ndarray, bits: int) -> DataFrame:
    """doc_id and run, for the runs of a text whose place in the bitmap is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.unpackbits(known).astype(bool)
        for batch in batches:
            data, offsets = _bytes(batch.column("low"))
            for a, b in _chunks(offsets):
                some, limits = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for size in SIZES:
                    keys, rows = _runs(some, limits, size)
                    hit = taken[_places(keys, bits)]
                    keys, rows = keys[hit], rows[hit]
                    order = np.lexsort((keys, rows))
                    keys, rows = keys[order], rows[order]
                    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])[: len(keys)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows[new] + a)), pa.array(keys[new].view(np.int64))], names=["doc_id", "run"])

    kind = low.schema["doc_id"].dataType.simpleString()
    return low.mapInArrow(run, f"doc_id {kind}, run long")


def contained(docs: DataFrame, terms: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and term_id of every term that a text contains. docs: doc_id, text; terms: term_id, term."""
    low = docs.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    wanted = terms.where(F.length("term") > 0).select("term_id", F.lower("term").alias("term"))
    runs = _term_runs(wanted.select("term").distinct(), bits)
    shared = runs.groupBy("run").agg(F.count("*").alias("n"))
    known = runs.join(shared, "run").groupBy("term").agg(F.min(F.struct("n", "run", "place")).alias("k")).select("term", "k.run", "k.place")
    taken = np.zeros(1 << bits, np.uint8)
    taken[[r["place"] for r in known.select("place").distinct().toLocalIterator()]] = 1  # 2**bits rows at most
    # Rows of one id send their pairs together, so that each of them meets a term once.
    pairs = _text_runs(low, np.packbits(taken), bits).join(known, "run").select("doc_id", "term").distinct()
    met = pairs.alias("p").join(low.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & F.contains("t.low", "p.term"))
    return met.select("p.doc_id", "p.term").join(wanted, "term").select("doc_id", "term_id")
