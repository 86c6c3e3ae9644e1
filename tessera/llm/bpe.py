"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation uses no regular expression. Each codepoint has a class (letter, number, white
space, ...); each class is a transition function of a small automaton that knows what the last
token was. Composing functions is associative, so the automaton's state after every codepoint
comes from a doubling scan over ids of composed functions; it ends once all are constant, which
is after a few steps. State, class and the next class then tell whether a token starts. The
pieces between starts go through a cache to pair merging by rank.

Null texts count as empty and give no tokens. Any text is taken whole; a piece of n bytes costs
n log n, so one long run of letters is no trap. Every row is coded for itself, repeated ones alike;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._bytes import blocks, string_parts
from tessera.llm._spark import text_of

# Classes of codepoints. Letters that can follow an apostrophe in a contraction have their own.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, PRE_E, PRE_L, E, END = range(11)
CLASSES = 11
# States: what the last codepoint belongs to.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_WHITE, AFTER_SPACE, AFTER_QUOTE, WANT_E, WANT_L, CLOSED = range(10)
STATES = 10
# The Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_ENTRIES = 300_000
WIDTHS = (8, 12, 16, 24, 40)


def _after(state: int, kind: int) -> int:
    """The automaton: state after reading one codepoint of a class."""
    if kind == SPACE:
        return AFTER_SPACE
    if kind == WHITE:
        return AFTER_WHITE
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == OTHER:
        return IN_OTHERS
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_SPACE, AFTER_QUOTE) else AFTER_QUOTE
    if state == AFTER_QUOTE:
        return {ONE: CLOSED, PRE_E: WANT_E, PRE_L: WANT_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((WANT_E, E), (WANT_L, PRE_L)):
        return CLOSED
    return IN_LETTERS


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each class's function and of its form at the start of a text, the composition table
    [later, earlier], and the value of each constant function (255: not constant)."""
    plain = [tuple(_after(s, c) for s in range(STATES)) for c in range(CLASSES - 1)]
    fresh = [(_after(NONE, c),) * STATES for c in range(CLASSES - 1)]
    known = list(dict.fromkeys(plain + fresh))
    at = {f: i for i, f in enumerate(known)}
    done = 0
    while done < len(known):
        g = known[done]
        for f in list(known):
            for later, earlier in ((g, f), (f, g)):
                both = tuple(later[earlier[s]] for s in range(STATES))
                if both not in at:
                    at[both] = len(known)
                    known.append(both)
        done += 1
    table = np.array([[at[tuple(g[f[s]] for s in range(STATES))] for f in known] for g in known], dtype=np.uint8)
    value = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], dtype=np.uint8)
    return np.array([at[f] for f in plain], dtype=np.uint8), np.array([at[f] for f in fresh], dtype=np.uint8), table, value


@cache
def _starts_token() -> np.ndarray:
    """Whether a codepoint starts a token, by [state before, class, next class]."""
    out = np.zeros((STATES, CLASSES, CLASSES), dtype=bool)
    for state in range(STATES):
        for kind in range(CLASSES - 1):
            for following in range(CLASSES):
                if kind in (SPACE, WHITE):
                    run = state in (AFTER_SPACE, AFTER_WHITE)
                    starts = not run or following not in (SPACE, WHITE, END)
                elif kind == NUMBER:
                    starts = state not in (IN_NUMBERS, AFTER_SPACE)
                elif kind in (OTHER, QUOTE):
                    starts = state not in (IN_OTHERS, AFTER_QUOTE, AFTER_SPACE)
                elif state == AFTER_QUOTE:
                    contracted = kind == ONE or (kind, following) in ((PRE_E, E), (PRE_L, PRE_L))
                    starts = not contracted
                else:
                    starts = state not in (IN_LETTERS, AFTER_SPACE, WANT_E, WANT_L)
                out[state, kind, following] = starts
    return out.reshape(-1)


@cache
def _class_table() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    for text, kind in (("'", QUOTE), ("stmd", ONE), ("rv", PRE_E), ("l", PRE_L), ("e", E)):
        out[[ord(c) for c in text]] = kind
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens start; rows never share a token."""
    if not len(data):
        return np.zeros(0, np.int64)
    plain, fresh, compose, value = _monoid()
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = _class_table()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    firsts = np.searchsorted(leads, offsets[:-1][offsets[:-1] < offsets[1:]])
    function = plain[kinds]
    function[firsts] = fresh[kinds[firsts]]
    step = 1
    while step < len(function) and (value[function] == 255).any():
        function[step:] = compose[function[step:], function[:-step]]
        step *= 2
    before = np.empty(len(kinds), dtype=np.intp)
    before[1:] = value[function[:-1]]
    before[firsts] = NONE
    following = np.empty(len(kinds), dtype=np.intp)
    following[:-1] = kinds[1:]
    following[-1] = END
    following[firsts[1:] - 1] = END
    return leads[_starts_token()[(before * CLASSES + kinds) * CLASSES + following]]


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id. The file is on the driver; tasks get the list by broadcast."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines) if token]
    out = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        out[rank] = token
    return out


class PieceCache:
    """Piece to its ids, as little-endian 32-bit integers. Misses of a block are merged together;
    full, the cache keeps one older generation."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.none = len(tokens)
        self.young: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bytes = np.array([self.rank.get(bytes([i]), 0) for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(ranks[order], np.int32(self.none))

    def code(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        if len(self.young) >= CACHE_ENTRIES:
            self.older, self.young = self.young, {}
        young, older = self.young, self.older
        new = set(pieces).difference(young)
        if older:
            young.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in young]
        by_width: dict[int, list[bytes]] = {}
        for x in new:
            n = len(x)
            if (rank := self.rank.get(x)) is not None:
                young[x] = rank.to_bytes(4, "little")
            elif n > WIDTHS[-1]:
                young[x] = np.array(self._merge_long(x), dtype="<u4").tobytes()
            else:
                by_width.setdefault(next(w for w in WIDTHS if n <= w), []).append(x)
        for width, group in by_width.items():
            for at in range(0, len(group), 16384):
                self._merge_many(group[at : at + 16384], width)
        return list(map(young.__getitem__, pieces))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; an id of -1 is no token."""
        keys = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(self.none))

    def _merge_many(self, group: list[bytes], width: int) -> None:
        """Joins the pair of lowest rank, leftmost first, in all pieces at once, until none has a pair."""
        n = len(group)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in group), dtype=np.uint8).reshape(n, width)
        size = np.array([len(x) for x in group])
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.bytes[raw], -1)
        ranks = np.full((n, width), self.none, dtype=np.int32)
        ranks[:, :-1] = self._ranks_of(ids[:, :-1], ids[:, 1:])
        open_ = np.arange(n)
        done = np.full((n, width), -1, dtype=np.int64)
        while len(open_):
            row = np.arange(len(open_))
            at = ranks.argmin(axis=1)
            least = ranks[row, at]
            going = least < self.none
            if not going.all():
                done[open_[~going]] = ids[~going]
                open_, ids, ranks, at, least = open_[going], ids[going], ranks[going], at[going], least[going]
                row = row[: len(open_)]
            ids[row, at] = least
            take = np.minimum(column + (column > at[:, None]), width - 1)
            last = ids[:, -1].copy()
            ids = np.take_along_axis(ids, take, axis=1)
            ids[:, -1] = np.where(at == width - 1, last, -1)
            take = np.minimum(column + (column >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, take, axis=1)
            ranks[:, -1] = self.none
            ranks[row, at] = self._ranks_of(ids[row, at], np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1))
            some = at > 0
            ranks[row[some], at[some] - 1] = self._ranks_of(ids[row[some], at[some] - 1], ids[row[some], at[some]])
        flat = done.astype("<u4").tobytes()
        counts = ((done >= 0).sum(axis=1) * 4).tolist()
        for i, (x, count) in enumerate(zip(group, counts, strict=True)):
            self.young[x] = flat[i * width * 4 : i * width * 4 + count]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, with a heap of pairs: n log n steps."""
        rank, n = self.rank, len(piece)
        ends = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, end = heapq.heappop(heap)
            middle = ends[left]
            if not alive[left] or middle >= n or ends[middle] != end:
                continue
            alive[middle] = False
            ends[left] = end
            if end < n:
                previous[end] = left
                if (r := rank.get(piece[left : ends[end]])) is not None:
                    heapq.heappush(heap, (r, left, ends[end]))
            before = previous[left]
            if before >= 0 and (r := rank.get(piece[before:end])) is not None:
                heapq.heappush(heap, (r, before, end))
        return [rank[piece[i : ends[i]]] for i in range(n) if alive[i]]


def encode_block(data: np.ndarray, offsets: np.ndarray, pieces: PieceCache) -> list[bytes]:
    """Ids of every row of a block, as little-endian 32-bit integers."""
    starts = piece_starts(data, offsets)
    raw = data.tobytes()
    cuts = [*starts.tolist(), len(raw)]
    coded = pieces.code([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    rows = np.searchsorted(starts, offsets).tolist()
    return [b"".join(coded[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, ids (binary, little-endian unsigned 32-bit) and the ends of the ids' byte
    spans in the text (binary, little-endian unsigned 64-bit), one row per document."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        pieces = PieceCache(tokens)
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                ids = encode_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], pieces)
                ends = [np.cumsum(lengths[np.frombuffer(x, dtype="<u4")]).astype("<u8").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a).cast(pa.string()), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())],
                    names=["doc_id", "text", "ids", "ends"],
                )

    return text_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, text string, ids binary, ends binary")


def token_digests(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.value
        pieces = PieceCache(tokens)
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                ids = encode_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(decode(x, tokens)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return text_of(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
