"""Packed chunks of documents, and exchange of per-chunk keys for corpus-wide answers.

A chunk is one row: some megabytes of texts, compressed, with their ids. Keys such as word or
n-gram hashes are made distinct within a chunk before they travel, so a key that every document
holds travels once per chunk, and no key is hot. Keys go to parts by hash; a part adds up each
key's numbers over all chunks and sends back, per chunk, the totals in the order asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm._bytes import blocks, string_parts
from tessera.llm._spark import materialise, text_of

CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
PACKED = "chunk long, kind int, ids binary, nulls binary, sizes binary, body binary"
ASKED = "chunk long, part int, keys binary, values binary"
ANSWERED = "chunk long, part int, answers binary"
_CODEC = "zstd"


def squeeze(raw: bytes | memoryview) -> bytes:
    """Compressed bytes with their length in front."""
    raw = bytes(raw)
    return len(raw).to_bytes(8, "little") + (pa.Codec(_CODEC).compress(raw, asbytes=True) if raw else b"")


def expand(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec(_CODEC).decompress(blob[8:], n, asbytes=True) if n else b""


def squeeze_numbers(numbers: np.ndarray) -> bytes:
    """Compressed unsigned numbers, in the least width that holds them; the width comes first."""
    most = int(numbers.max()) if numbers.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + squeeze(np.ascontiguousarray(numbers.astype(f"<u{width}")).tobytes())


def expand_numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(expand(blob[1:]), dtype=f"<u{blob[0]}").astype(np.int64)


@dataclass
class Chunk:
    """Texts end to end, their limits and ids. A null id sorts last and stays null."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)

    def take(self, rows: np.ndarray) -> Chunk:
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows.tolist()]
        sizes = np.diff(self.offsets)[rows]
        return Chunk(np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([[0], np.cumsum(sizes)]), self.ids[rows], self.nulls[rows])

    def packed(self, chunk: int, kind: int) -> dict:
        sizes = np.diff(self.offsets).astype("<i8")
        return {"chunk": chunk, "kind": kind, "ids": squeeze(self.ids.astype("<i8").tobytes()), "nulls": squeeze(self.nulls.tobytes()), "sizes": squeeze(sizes.tobytes()), "body": squeeze(self.data.tobytes())}


def packed_rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """The rows of a packed table, one at a time."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def unpack(row: dict) -> Chunk:
    sizes = np.frombuffer(expand(row["sizes"]), dtype="<i8")
    return Chunk(
        np.frombuffer(expand(row["body"]), dtype=np.uint8),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.frombuffer(expand(row["ids"]), dtype="<i8").astype(np.int64),
        np.frombuffer(expand(row["nulls"]), dtype=bool),
    )


def pack(docs: DataFrame, kind_of: Callable[[pa.Array], np.ndarray] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the documents as chunks, one row each, and reads the table back. Documents of
    different kinds (numbers from 0) never share a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[Chunk]] = {}
        sizes: dict[int, int] = {}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal number
            parts = waiting.pop(kind)
            sizes.pop(kind)
            ends = np.cumsum([0] + [len(p.data) for p in parts])
            joined = Chunk(
                np.concatenate([p.data for p in parts]),
                np.concatenate([[0], *(p.offsets[1:] + e for p, e in zip(parts, ends, strict=False))]),
                np.concatenate([p.ids for p in parts]),
                np.concatenate([p.nulls for p in parts]),
            )
            number += 1
            return batch_of([joined.packed(number, kind)], PACKED)

        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            ids = batch.column("doc_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            kinds = kind_of(ids) if kind_of else np.zeros(len(ids), int)
            whole = Chunk(data, offsets, numbers, nulls)
            for kind in np.unique(kinds).tolist():
                part = whole if (kinds == kind).all() else whole.take(np.flatnonzero(kinds == kind))
                for a, b in blocks(part.offsets, chunk_bytes // 4):
                    piece = Chunk(part.data[part.offsets[a] : part.offsets[b]], part.offsets[a : b + 1] - part.offsets[a], part.ids[a:b], part.nulls[a:b])
                    if kind in waiting and sizes[kind] + len(piece.data) > chunk_bytes:
                        yield flush(kind)
                    waiting.setdefault(kind, []).append(piece)
                    sizes[kind] = sizes.get(kind, 0) + len(piece.data)
        for kind in sorted(waiting):
            yield flush(kind)

    return materialise(text_of(docs).mapInArrow(run, PACKED), "chunks")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows as a record batch with a DDL schema of plain types; missing values are null."""
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key, by its high bits: sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def ask(chunk: int, keys: np.ndarray, values: np.ndarray, parts: int, width: int = 8) -> list[dict]:
    """Requests for sorted distinct keys, with columns of numbers to add up. Of each key, the low
    `width` bytes travel; the part tells its high bits roughly."""
    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    small = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    out = []
    for p in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
        a, b = cuts[p], cuts[p + 1]
        out.append({"chunk": chunk, "part": p, "keys": small[a:b].tobytes(), "values": squeeze_numbers(values[a:b].T)})
    return out


def answer(asked: DataFrame, columns: int, widths: tuple[int, ...] = (8,)) -> DataFrame:
    """For each request, the totals of its keys; plus one row per part under chunk -1: the sum of
    each column and the number of keys with any sum above zero. Part p has keys of widths[p % len]."""

    def run(table: pa.Table) -> pa.Table:
        chunks, parts = table.column("chunk").to_pylist(), table.column("part").to_pylist()
        width = widths[parts[0] % len(widths)]
        keys, values, sizes = [], [], []
        for k, v in zip(table.column("keys"), table.column("values"), strict=True):
            raw = np.frombuffer(k.as_buffer(), dtype=np.uint8).reshape(-1, width)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :width] = raw
            keys.append(wide.view("<u8").reshape(-1))
            values.append(expand_numbers(v.as_py()).reshape(columns, -1))
            sizes.append(len(raw))
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        ordered = flat[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first, run_of = np.flatnonzero(new), np.cumsum(new) - 1
        numbers = np.concatenate(values, axis=1)
        sums = np.stack([np.add.reduceat(numbers[c][order], first) for c in range(columns)])
        totals = np.empty((columns, len(flat)), np.int64)
        totals[:, order] = sums[:, run_of]
        facts = [*sums.sum(axis=1).tolist(), int((sums.sum(axis=0) > 0).sum())]
        rows = [{"chunk": -1, "part": parts[0], "answers": np.array(facts, "<i8").tobytes()}]
        at = 0
        for chunk, part, n in zip(chunks, parts, sizes, strict=True):
            rows.append({"chunk": chunk, "part": part, "answers": squeeze_numbers(totals[:, at : at + n])})
            at += n
        return pa.Table.from_batches([batch_of(rows, ANSWERED)])

    return asked.select("chunk", "part", "keys", "values").groupBy("part").applyInArrow(run, ANSWERED)


def repeats(asked: DataFrame) -> DataFrame:
    """For each request, those of its keys whose numbers add up to more than one, in order."""

    def run(table: pa.Table) -> pa.Table:
        chunks, parts = table.column("chunk").to_pylist(), table.column("part").to_pylist()
        keys = [np.frombuffer(k.as_buffer(), dtype="<u8") for k in table.column("keys")]
        counts = [expand_numbers(v.as_py()) for v in table.column("values")]
        _, place = distinct(np.concatenate(keys))
        often = np.bincount(place, np.concatenate(counts))[place] > 1
        rows, at = [], 0
        for chunk, part, k in zip(chunks, parts, keys, strict=True):
            found = k[often[at : at + len(k)]]
            at += len(k)
            if len(found):
                rows.append({"chunk": chunk, "part": part, "answers": found.tobytes()})
        return pa.Table.from_batches([batch_of(rows, ANSWERED)])

    return asked.select("chunk", "part", "keys", "values").groupBy("part").applyInArrow(run, ANSWERED)


def read_keys(table: pa.Table) -> np.ndarray:
    """Keys that `repeats` sent to one chunk, sorted."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("answers").to_pylist(), strict=True))
    return np.frombuffer(b"".join(a for _, a in rows), dtype="<u8").astype(np.uint64)


def read_answers(table: pa.Table, columns: int) -> np.ndarray:
    """All answers to one chunk, in the order of its sorted keys: one row per column."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("answers").to_pylist(), strict=True))
    got = [expand_numbers(a).reshape(columns, -1) for _, a in rows]
    return np.concatenate(got, axis=1) if got else np.zeros((columns, 0), np.int64)


def parts_for(chunks: DataFrame) -> int:
    """Parts for the keys of all chunks: two a shuffle partition, more for very many chunks."""
    return max(1, 2 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // 8)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place
