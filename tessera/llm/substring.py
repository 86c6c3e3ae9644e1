"""Substring dedup: windows of consecutive words that occur earlier, by super-k-mer partitioning.

A window is WINDOW consecutive words of one document; its minimiser is the least hash among its
MINIMISER-word runs. Consecutive windows with one minimiser make a super-k-mer.

1. Occurrences of minimisers are counted over the corpus. A window whose minimiser occurs once is
   unique; its documents are mostly settled here.
2. The other windows' hashes are counted. Windows that straddle the edge of a shared passage fall
   out, however common the passage is.
3. What is left repeats. In each chunk, the first occurrence of every such window travels to the
   bucket of its minimiser, consecutive ones packed as one string with its place. The bucket cuts
   the strings into windows, sorts them, and finds the first place of each exactly.
4. A chunk learns which of its windows are the first of their kind; all others are removed.

Keys and strings are distinct within a chunk, so a bucket gets a common passage once per chunk,
never once per document. A window counts as earlier by (doc_id, start); null ids come last.
Null and empty texts have no words. Rows that repeat with one id are equally early: neither is
removed for the other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import blocks, gram_hashes, sliding_min, word_hashes, word_spans
from tessera.llm._chunks import ANSWERED, ASKED, PACKED, Chunk, answer, ask, batch_of, distinct, expand, pack, packed_rows, part_of, parts_for, read_answers, read_keys, repeats, squeeze, unpack
from tessera.llm._spark import materialise

WINDOW = 20
MINIMISER = 8
# Buckets of strings for each part of keys: strings take more memory than keys.
BUCKETS_PER_PART = 4
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SENT = "chunk long, part int, strings binary, ids binary, starts binary"


class Words:
    """Words of a chunk, and the windows and minimisers among them."""

    def __init__(self, chunk: Chunk) -> None:
        starts, ends, rows, hashes = [], [], [], []
        for a, b in blocks(chunk.offsets):
            at = chunk.offsets[a]
            data, offsets = chunk.data[at : chunk.offsets[b]], chunk.offsets[a : b + 1] - at
            s, e, r = word_spans(data, offsets)
            hashes.append(word_hashes(data, s, e))
            starts.append(s + at)
            ends.append(e + at)
            rows.append(r + a)
        none = np.zeros(0, np.int64)
        self.chunk, self.n = chunk, len(chunk.ids)
        self.starts, self.ends, self.rows = (np.concatenate([none, *x]) for x in (starts, ends, rows))
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.limits = np.searchsorted(self.rows, np.arange(self.n + 1))
        n = max(0, len(self.rows) - WINDOW + 1)
        self.valid = self.rows[WINDOW - 1 :] == self.rows[:n]
        self.grams = gram_hashes(self.hashes, self.rows, MINIMISER)[0]
        self.least = sliding_min(self.grams, WINDOW - MINIMISER + 1)

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimisers of the windows, with the number of their occurrences."""
        span = WINDOW - MINIMISER + 1
        # An occurrence is a run that is least in some window over it: the greatest of the minima
        # of the windows that cover the run equals its own hash.
        low = np.where(self.valid, self.least, np.uint64(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
        greatest = ~sliding_min(~padded, span)
        found = self.grams[(greatest == self.grams) & (greatest > 0)] if len(self.grams) else self.grams
        keys, place = distinct(found)
        return keys, np.bincount(place, minlength=len(keys))

    def window_hashes(self) -> np.ndarray:
        return gram_hashes(self.hashes, self.rows, WINDOW)[0]


def _finished(w: Words, rows: np.ndarray, removed: np.ndarray | None = None) -> pa.RecordBatch:
    """Results of some rows; `removed` marks words."""
    raw, out = w.chunk.data.tobytes(), []
    for i in rows.tolist():
        a, b = int(w.limits[i]), int(w.limits[i + 1])
        words = raw[w.chunk.offsets[i] : w.chunk.offsets[i + 1]].split()
        gone = 0
        if removed is not None:
            keep = ~removed[a:b]
            gone = int(b - a - keep.sum())
            words = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
        out.append((b - a, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [w.chunk.id_array().take(pa.array(rows)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def _mixed(*schemas: str) -> str:
    """One schema of all columns, for a table that holds several kinds of rows."""
    return ", ".join(dict.fromkeys(c for s in schemas for c in s.split(", ")))


def _widen(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    empty = batch_of([], schema)
    columns = [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in empty.schema]
    return pa.RecordBatch.from_arrays(columns, schema=empty.schema)


def dedup_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    chunks = pack(docs)
    parts = parts_for(chunks)

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in packed_rows(batch):
                keys, counts = Words(unpack(packed)).minimisers()
                yield batch_of(ask(packed["chunk"], keys, counts[:, None], parts), ASKED)

    counted = answer(chunks.mapInArrow(minimisers, ASKED), 1).where("chunk >= 0")

    # The settled documents, the rest packed anew, and the hashes of windows that may repeat.
    second = _mixed(_DONE, PACKED, ASKED)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in packed_rows(left):
            w = Words(unpack(packed))
            keys, _ = w.minimisers()
            often = keys[read_answers(right, 1)[0] > 1]
            some = w.valid & _among(w.least, often)
            open_ = np.zeros(w.n, dtype=bool)
            open_[w.rows[: len(some)][some]] = True
            out.append(_widen(_finished(w, np.flatnonzero(~open_)), second))
            if open_.any():
                out.append(_widen(batch_of([w.chunk.take(np.flatnonzero(open_)).packed(packed["chunk"], 0)], PACKED), second))
            hashes, place = distinct(w.window_hashes()[some])
            counts = np.minimum(np.bincount(place, minlength=len(hashes)), 2)
            out.append(_widen(batch_of(ask(packed["chunk"], hashes, counts[:, None], parts), ASKED), second))
        return pa.Table.from_batches(out or [batch_of([], second)])

    mixed = materialise(chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(windows, second), "windows")
    settled = mixed.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    rest = mixed.where("body IS NOT NULL").select("chunk", "kind", "ids", "nulls", "sizes", "body")
    repeated = materialise(repeats(mixed.where("keys IS NOT NULL")), "repeats")

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in packed_rows(left):
            w = Words(unpack(packed))
            first = _first_places(w, right)[1]
            out += _super_kmers(w, first, packed["chunk"], parts * BUCKETS_PER_PART)
        return pa.Table.from_batches([batch_of(out, _SENT)])

    sent = rest.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(strings, _SENT)
    firsts = sent.groupBy("part").applyInArrow(_sort_bucket, ANSWERED)

    # Answers of both kinds for the last pass: counts of hashes, and the windows that are first.
    both = repeated.withColumn("first", F.lit(False)).unionByName(firsts.withColumn("first", F.lit(True)))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in packed_rows(left):
            w = Words(unpack(packed))
            is_first = right.column("first").to_numpy(zero_copy_only=False).astype(bool)
            again, mine = _first_places(w, right.filter(pa.array(~is_first)))
            kept = _kept_places(w, mine, right.filter(pa.array(is_first)), parts * BUCKETS_PER_PART)
            gone = again.copy()
            gone[kept] = False
            change = np.zeros(len(w.rows) + 1, np.int64)
            at = np.flatnonzero(gone)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            out.append(_finished(w, np.arange(w.n), np.cumsum(change)[:-1] > 0))
        return pa.Table.from_batches(out or [batch_of([], _DONE)])

    cleaned = rest.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, _DONE)
    return settled.unionByName(cleaned)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted keys; runs of equal values are looked up once."""
    if not len(values) or not len(keys):
        return np.zeros(len(values), dtype=bool)
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    at = np.minimum(np.searchsorted(keys, values[heads]), len(keys) - 1)
    return np.repeat(keys[at] == values[heads], np.diff(np.append(heads, len(values))))


def _first_places(w: Words, repeated: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Marks the windows that repeat in the corpus; and the places in the chunk, in (id, start)
    order, of the first window of each kind. Equally early windows all count as first."""
    n = max(0, len(w.rows) - WINDOW + 1)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0, np.int64)
    hashes = w.window_hashes()
    again = w.valid & _among(hashes, read_keys(repeated))
    places = np.flatnonzero(again)
    ids, starts = w.chunk.ids[w.rows[places]], places - w.limits[w.rows[places]]
    order = np.lexsort((starts, ids, hashes[places]))
    h, i, s = hashes[places][order], ids[order], starts[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    first = (i == i[head]) & (s == s[head])
    return again, np.sort(places[order][first])


def _runs(w: Words, first: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers among some windows: first place, number of windows and part, by (part, place)."""
    least, rows = w.least[first], w.rows[first]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (np.diff(first) != 1) | (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(first)))
    part = part_of(least[heads], parts)
    order = np.lexsort((first[heads], part))
    return first[heads][order], counts[order], part[order]


def _super_kmers(w: Words, first: np.ndarray, chunk: int, parts: int) -> list[dict]:
    """The runs as strings, one row per part."""
    places, counts, part = _runs(w, first, parts)
    raw = w.chunk.data.tobytes()
    texts = [b" ".join(raw[w.starts[p] : w.ends[p + n + WINDOW - 2]].split()) for p, n in zip(places.tolist(), counts.tolist(), strict=True)]
    rows = w.rows[places]
    ids, starts = w.chunk.ids[rows], places - w.limits[rows]
    out = []
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append({"chunk": chunk, "part": int(part[a]), "strings": squeeze(b"\n".join(texts[a:b])), "ids": squeeze(ids[a:b].astype("<i8").tobytes()), "starts": squeeze(starts[a:b].astype("<i8").tobytes())})
    return out


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Whether each window of each string is the first of its kind in the bucket, as bits.

    Windows are compared exactly: words get numbers, and ranks of runs of 1, 2, 4, 8 and 16 words
    come from sorting pairs of ranks of half the length."""
    rows = table.to_pylist()
    known: dict[bytes, int] = {}
    numbers, lengths, ids, starts = [], [], [], []
    for r in rows:
        own = []
        for text in expand(r["strings"]).split(b"\n"):
            words = text.split(b" ")
            own += [known.setdefault(x, len(known)) for x in words]
            lengths.append(len(words))
        numbers.append(np.array(own, dtype=np.int64))
        ids.append(np.frombuffer(expand(r["ids"]), dtype="<i8"))
        starts.append(np.frombuffer(expand(r["starts"]), dtype="<i8"))
    rank = np.concatenate(numbers)
    sizes = np.array(lengths)
    ranks = {1: rank}
    for k in (2, 4, 8, 16):
        half = ranks[k // 2]
        ranks[k] = distinct(half[: -k // 2] << 32 | half[k // 2 :])[1]
    whole = distinct(ranks[16][: len(rank) - WINDOW + 1] << 32 | ranks[4][16 : 16 + len(rank) - WINDOW + 1])[1]
    per = sizes - WINDOW + 1
    base = np.repeat(np.cumsum(sizes) - sizes, per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    kind = whole[base + within]
    owner = np.repeat(np.concatenate(ids), per)
    start = np.repeat(np.concatenate(starts), per) + within
    order = np.lexsort((start, owner, kind))
    k, o, s = kind[order], owner[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    first = np.zeros(len(k), dtype=bool)
    first[order] = (o == o[head]) & (s == s[head])
    out, at, string = [], 0, 0
    for r, own in zip(rows, ids, strict=True):
        n = int(per[string : string + len(own)].sum())
        string += len(own)
        out.append({"chunk": r["chunk"], "part": r["part"], "answers": np.packbits(first[at : at + n]).tobytes()})
        at += n
    return pa.Table.from_batches([batch_of(out, ANSWERED)])


def _kept_places(w: Words, first: np.ndarray, answers: pa.Table, parts: int) -> np.ndarray:
    """Places of the windows that are the first of their kind in the corpus."""
    places, counts, part = _runs(w, first, parts)
    bits = dict(zip(answers.column("part").to_pylist(), answers.column("answers").to_pylist(), strict=True))
    kept = []
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = counts[a:b]
        at = np.repeat(places[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flags = np.unpackbits(np.frombuffer(bits[int(part[a])], dtype=np.uint8))[: len(at)].astype(bool)
        kept.append(at[flags])
    return np.concatenate([np.zeros(0, np.int64), *kept])
