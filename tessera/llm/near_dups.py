"""Near-duplicates by order MinHash, verified by banded alignment.

Each text's K-word runs are labelled with their occurrence number. For each of SKETCHES hash
functions, the ELL runs of least hash are kept in their order in the text: two texts share such a
sketch with a chance that follows their edit similarity, not just their overlap. Texts of at most
SHORT_TEXT words, of which scattered edits leave few five-word runs whole, have SHORT_SKETCHES
sketches of SHORT_K-word runs besides. Texts that share a sketch meet in its bucket. Texts of at
most SHORT_WORDS words also meet if they become equal when up to a fifth of their words is left
out: all links between them are found. Two texts are linked if their word edit distance is at most
a fifth of the longer one's length (similarity 0.8), which a banded alignment decides exactly.
Classes are the connected components of the links. Equal texts are one node from the start.

Within a bucket every text is aligned with a leader, the text with the fullest buckets: the
original of a group of copies is in more of them than any copy. In a bucket of at most BUCKET
texts, those that are not linked to the leader are then aligned with all others there. A sketch of
more texts than that, which a quoted passage may be, is not enough to tell texts: their sketches
grow by the runs of the next one, two, four and eight hash functions, each time with a leader,
until at most BUCKET texts share them. Besides, its texts are sketched again from the words that the
runs of full buckets leave, in rounds, until hardly any are in full buckets: so a pair of texts that
both quote a common passage meets through the rest of them, or, where almost nothing is left, through
the leader, which has little else itself. So far the work is in proportion to the number of sketches,
whatever the size of a group, and most texts of a full bucket are of one class. The rest is exact: of
linked texts all but a fifth of the longer one's words are in common, so they share one of the rarest words,
a fifth of them and one more. Texts of full buckets, the same or not, that are of different classes meet by
these words; bitmaps of their words rule out what cannot be linked, the alignment decides what is left. So no
two texts of full buckets are of different classes if they are linked.

Texts with a remnant in common fall into groups by the places of the words left out. Those of one
group differ in just these words, so all are linked to its first text; whether texts of two groups
are linked depends on the places, so the first texts decide. There are at most 106 groups.

Null and empty texts, having no words, are all alike and form one class. Texts of fewer than K
words count as one run. Null ids sort last. Repeated rows are copies like any other; one stays.
An empty table gives no rows. Extra columns, whatever their names, pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import blocks, gram_hashes, mix, string_parts, word_hashes, word_spans
from tessera.llm._spark import discard, fresh, materialise
from tessera.llm.components import components

K = 5
ELL = 2
SKETCHES = 80
SHORT_TEXT = 80
SHORT_K = 3
SHORT_SKETCHES = 40
SHORT_WORDS = 14
BUCKET = 16
GROWTH = (1, 2, 4, 8)
REST_KINDS = [(10, K), (50, SHORT_K), (80, 2)]  # (sketches, words of a run) of what full buckets leave of a text
REST_ROUNDS = 3
REST_WORDS = 3
BLOCK_WORDS = 1 << 18  # of a block of texts of a full bucket; a text counts as LEAST_WORDS at least
LEAST_WORDS = 128
ORDER_BITS = 18
ORDER_TEXTS = 1 << 14
SIMILARITY = 0.8
_STRAY = np.uint64(0x8BB84B93962EACC9)


# Sketches


def _labelled_runs(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of occurrence-labelled runs, with their rows, in text order; every row has some."""
    grams, valid = gram_hashes(words, rows, k)
    grams, at = grams[valid], rows[: len(grams)][valid]
    key = mix(grams + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        some = np.flatnonzero(twice[place] == key)
        order = np.argsort(key[some], kind="stable")
        near = key[some][order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], near[1:] != near[:-1]]), np.arange(len(near)), 0))
        number = np.arange(len(near)) - head
        grams = grams.copy()
        grams[some[order]] += number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    short = np.flatnonzero(np.bincount(at, minlength=n_rows) == 0)
    if len(short):
        limits = np.searchsorted(rows, np.arange(n_rows + 1))
        whole = []
        for r in short.tolist():
            own = words[limits[r] : limits[r + 1]]
            whole.append(gram_hashes(own, np.zeros(len(own), int), len(own))[0][0] if len(own) else _STRAY)
        grams, at = np.concatenate([grams, np.array(whole, dtype=np.uint64)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, at


def sketched_runs(words: np.ndarray, rows: np.ndarray, n_rows: int, count: int = SKETCHES, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Order-MinHash sketches, one row per text, and the words (places in the text) at which the runs
    of each start. Sketches of different functions or k differ."""
    runs, at = _labelled_runs(words, rows, n_rows, k)
    out, picks = np.empty((n_rows, count), np.uint64), np.zeros((n_rows, count, ELL), np.int64)
    if not n_rows:
        return out, picks
    sizes = np.bincount(at, minlength=n_rows)
    starts = np.cumsum(sizes) - sizes
    high, last = (runs >> np.uint64(32)).astype(np.uint32), np.uint32(2**32 - 1)
    draw = np.random.default_rng(1000 + k)
    for j in range(count):
        values = (high ^ draw.integers(0, 2**32, dtype=np.uint32)) * (draw.integers(0, 2**32, dtype=np.uint32) | np.uint32(1))
        places = np.empty((ELL, n_rows), np.int64)
        for e in range(ELL):
            least = np.minimum.reduceat(values, starts)
            hit = np.flatnonzero(values == np.repeat(least, sizes))
            if len(hit) > n_rows:  # equal values: the first in the text
                hit = hit[np.searchsorted(at[hit], np.arange(n_rows))]
            places[e] = hit
            values[hit] = last
        places.sort(axis=0)
        sketch = np.full(n_rows, k * 1000 + j, np.uint64)
        for e in range(ELL):
            sketch = mix(sketch * np.uint64(0x9E3779B97F4A7C15) + runs[places[e]], e)
        out[:, j], picks[:, j] = sketch, (places - starts).T
    return out, picks


def sketches(words: np.ndarray, rows: np.ndarray, n_rows: int, count: int = SKETCHES, k: int = K) -> np.ndarray:
    return sketched_runs(words, rows, n_rows, count, k)[0]


def without_crowded(words: np.ndarray, rows: np.ndarray, n_rows: int, crowded: list[list[int]], kinds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The words, with their rows, that no run of a crowded sketch covers. crowded: numbers of sketches
    of each text; kinds: (count, k) of the sketches that the numbers run through."""
    sizes = np.bincount(rows, minlength=n_rows)
    firsts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(n_rows), [len(c) for c in crowded])
    number = np.concatenate([np.array(c, np.int64) for c in crowded]) if crowded else np.zeros(0, np.int64)
    edges, done = np.zeros(len(words) + 1, np.int64), 0
    for count, k in kinds:
        mine = (number >= done) & (number < done + count)
        if mine.any():
            picks = sketched_runs(words, rows, n_rows, count, k)[1]
            r = np.repeat(row[mine], ELL)
            start = firsts[r] + picks[row[mine], number[mine] - done].reshape(-1)
            np.add.at(edges, start, 1)
            np.add.at(edges, np.minimum(start + k, firsts[r] + sizes[r]), -1)
        done += count
    kept = np.cumsum(edges[:-1]) == 0
    return words[kept], rows[kept]


def remnants(words: np.ndarray) -> tuple[list[int], list[int]]:
    """Hashes of what a short text can be when up to a fifth of its words is left out, and the
    places left out, as bits, with the length of the text. Texts within a fifth of the longer one's
    words have such a remnant in common."""
    n = len(words)
    most = int(n * (1 - SIMILARITY) + 1e-9)
    if not n or n > SHORT_WORDS:
        return [], []
    hashes, places = [], []
    for gone in range(most + 1):
        kept = np.array(list(combinations(range(n), n - gone)))
        value = np.full(len(kept), n - gone, np.uint64)
        for c in range(n - gone):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[kept[:, c]], c)
        hashes += value.view(np.int64).tolist()
        places += ((np.int64(1) << kept).sum(axis=1) + (n << 32)).tolist()
    return hashes, places


# Alignment


def _band(a: list[int], b: list[int], t: int) -> int:
    """Edit distance of two sequences if it is at most t, else t + 1; their lengths differ by t at
    most. Cells further than t from the diagonal are left out. A column of the table is held as the
    bits of its rises and falls, so the band moves on by whole words of the machine."""
    n, m = len(a), len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, foot = (1 << 2 * t + 1) - 1, 1 << 2 * t
    # Bit k of column j is row j - t + k; above the first row nothing rises.
    rises, falls = (every >> t) << t, 0
    cost = min(n, t)
    most = t + m - n + t  # what later columns can still bring down to t
    for j, x in enumerate(b):
        equal = places.get(x, 0)
        equal = (equal >> j - t if j >= t else equal << t - j) & every
        level = ((((equal & rises) + rises) & every) ^ rises) | equal | falls  # no step along the diagonal
        up, down = falls | (every ^ (level | rises)), level & rises  # steps from the column before
        if j + t < n:  # the lowest row of the band
            cost += not level & foot
        else:  # the last row of the table
            row = n - 1 - j + t
            cost += (up >> row & 1) - (down >> row & 1)
        if cost > most:
            return t + 1
        level >>= 1
        rises, falls = down | (every ^ (level | up)), level & up
    return min(cost, t + 1)


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Word edit distance of two texts if it is at most the limit, else some greater number."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if len(b) - n > limit:
        return len(b) - n
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = len(a)
    differ = np.flatnonzero(a[::-1] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: n - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    # Words in one bag only need an edit each.
    _, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    bags = [np.bincount(x, minlength=len(place)) for x in (place[: len(a)], place[len(a) :])]
    least = len(b) - int(np.minimum(*bags).sum())
    return least if least > limit else _band(place[: len(a)].tolist(), place[len(a) :].tolist(), limit)


# Spark


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), n_words, sketches and remnants of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                part, limits = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = word_spans(part, limits)
                words, sizes = word_hashes(part, starts, ends), np.bincount(rows, minlength=b - a).astype(np.int64)
                few = np.flatnonzero(sizes <= SHORT_TEXT)
                inside = sizes[rows] <= SHORT_TEXT
                every = sketches(words, rows, b - a)
                short = sketches(words[inside], np.searchsorted(few, rows[inside]), len(few), SHORT_SKETCHES, SHORT_K)
                width = np.full(b - a, SKETCHES)
                width[few] += SHORT_SKETCHES
                ends = np.cumsum(width)
                made = np.empty(ends[-1], np.uint64)
                made[((ends - width)[:, None] + np.arange(SKETCHES)).reshape(-1)] = every.reshape(-1)
                made[(ends[few][:, None] - SHORT_SKETCHES + np.arange(SHORT_SKETCHES)).reshape(-1)] = short.reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(made.view(np.int64)))
                firsts = np.cumsum(sizes) - sizes
                left = [remnants(words[i : i + n]) if n <= SHORT_WORDS else ([], []) for i, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a).cast(pa.binary()), pa.array(sizes), lists, *(pa.array([x[i] for x in left], pa.list_(pa.int64())) for i in (0, 1))],
                    names=["doc_id", "key", "n_words", "sketches", "remnants", "places"],
                )

    columns = "doc_id long, key binary, n_words long, sketches array<long>, remnants array<long>, places array<long>"
    return docs.select("doc_id", "key", "text").mapInArrow(run, columns)


def _hashed(texts: DataFrame) -> DataFrame:
    """node and the word hashes of each text, for alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, rows = word_spans(part, offsets[a : b + 1] - offsets[a])
                hashes = word_hashes(part, starts, ends)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                words = pa.array([hashes[i:j].astype("<u8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), words], names=["node", "words"])

    return texts.select("node", "text").mapInArrow(run, "node long, words binary")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("w_a"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("w_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "w_a", "w_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("w_a"), batch.column("w_b"), strict=True):
                a, b = (np.frombuffer(w.as_buffer(), "<u8") for w in (x, y))
                limit = int(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)
                near.append(edit_distance(a, b, limit) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _again(crowded: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """node, n_words, the words that no crowded run covers, and the sketches of these (of REST_KINDS), of
    texts that have REST_WORDS of them. crowded: node, n_words, words, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                each = [np.frombuffer(w.as_buffer(), "<u8") for w in batch.column("words")]
                words, rows = np.concatenate(each), np.repeat(np.arange(len(each)), [len(w) for w in each])
                words, rows = without_crowded(words, rows, len(each), batch.column("places").to_pylist(), kinds)
                left = np.flatnonzero(np.bincount(rows, minlength=len(each)) >= REST_WORDS)
                inside = np.isin(rows, left)
                words, rows = words[inside], np.searchsorted(left, rows[inside])
                made = np.concatenate([sketches(words, rows, len(left), count, k) for count, k in REST_KINDS], axis=1)
                cuts = np.searchsorted(rows, np.arange(len(left) + 1))
                rest = pa.array([words[i:j].astype("<u8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1).view(np.int64)))
                held = batch.take(pa.array(left))
                yield pa.RecordBatch.from_arrays([held.column("node"), held.column("n_words"), rest, tokens], names=["node", "n_words", "words", "tokens"])

    return crowded.select("node", "n_words", "words", "places").mapInArrow(run, "node long, n_words int, words binary, tokens array<long>")


def _remainders(members: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Postings (node, n_words, token, n) of texts in full buckets, sketched without the runs that fill
    them, again and again: each round leaves a text fewer words. After REST_ROUNDS rounds a text goes on
    only while a tenth of its sketches or more are in full buckets, so the rounds come to an end."""
    levels, number = [], 0
    full, held, kinds, least = members.where(F.col("n") > BUCKET), texts, [(SKETCHES, K), (SHORT_SKETCHES, SHORT_K)], 1
    while True:
        crowded = full.groupBy("node").agg(F.first("n_words").alias("n_words"), F.collect_set("place").alias("places"))
        crowded = materialise(crowded.where(F.size("places") >= least), "crowded")
        if not crowded.limit(1).count():
            discard(crowded)
            break
        number += 1
        rest = materialise(_again(crowded.join(held, "node"), kinds), "rest")
        tokens = rest.select("node", "n_words", F.posexplode("tokens").alias("place", "token"))
        posted = materialise(_shared(tokens.withColumn("token", F.xxhash64("token", F.lit(number)))), "again")
        levels.append(posted)
        full, kinds = posted.where(F.col("n") > BUCKET), REST_KINDS
        least = 1 if number < REST_ROUNDS else sum(c for c, _ in REST_KINDS) // 10
        discard(crowded)
        if held is not texts:
            discard(held)
        held = rest.select("node", "words")
    if held is not texts:
        discard(held)
    return levels


def _paired(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b), a < b."""
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _shared(postings: DataFrame) -> DataFrame:
    """The postings whose token other texts have too, with the number n of texts."""
    counts = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return postings.join(counts, "token")


def _alike(n: str, m: str) -> Column:
    """Whether lengths allow a link."""
    return F.abs(F.col(n) - F.col(m)) <= F.floor(F.greatest(n, m) * (1 - SIMILARITY) + 1e-9)


def bitmap(runs: np.ndarray, n_words: int) -> np.ndarray:
    """Bits, four to eight a word, at which hashes of a text's labelled words fall."""
    bits = np.zeros(max(64, 1 << (4 * n_words - 1).bit_length()), np.uint8)
    bits[(runs >> np.uint64(20)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps (one a row), made as short as `size` bytes: what falls together is set if any is."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, size), axis=1)


def slack(bits: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) in left and right of the pairs of texts that may share as many words as linked texts
    must, and how many more they may share. A bit of one text that the other lacks is a word at least."""
    width = np.array([len(b) for b in bits])
    found = []
    for low in np.unique(width):
        for x_size, y_size in ((low, low), (low, 2 * low), (2 * low, low)):  # lengths of linked texts are within a quarter
            i, j = np.flatnonzero(width[left] == x_size), np.flatnonzero(width[right] == y_size)
            if not len(i) or not len(j):
                continue
            x, y = (np.unpackbits(_folded(np.stack([bits[t] for t in texts]), low), axis=1).astype(np.float32) for texts in (left[i], right[j]))
            n, m = sizes[left[i]][:, None], sizes[right[j]][None, :]
            longest = np.maximum(n, m)
            limit = np.floor(longest * (1 - SIMILARITY) + 1e-9)
            most = x @ y.T + np.minimum(n - x.sum(axis=1)[:, None], m - y.sum(axis=1)[None, :])
            more = np.where(np.abs(n - m) <= limit, most - (longest - limit), -1)
            p, r = np.nonzero(more >= 0)
            found.append((i[p], j[r], more[p, r].astype(np.int64)))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts by hundreds, their lengths, and the labelled words with their rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            each = [np.frombuffer(w.as_buffer(), "<u8") for w in batch.column("words")]
            sizes = np.array([len(w) for w in each])
            yield batch, sizes, *_labelled_runs(np.concatenate(each), np.repeat(np.arange(len(each)), sizes), len(each), 1)


def _order(texts: DataFrame) -> np.ndarray:
    """How frequent the words of each of 2**ORDER_BITS parts of the hashes are, in steps of an eighth of a
    power of two, by at most about ORDER_TEXTS texts. Any order of words is right; this puts rare ones first."""
    every = max(1, -(-texts.count() // ORDER_TEXTS))
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for _, _, runs, _ in _each(batches):
            counts += np.bincount((runs >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], names=["place", "n"])

    counts = np.zeros(1 << ORDER_BITS)
    table = sample.select("words").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("place").to_numpy()] = table.column("n").to_numpy()
    return np.ceil(np.log2(1 + counts) * 8).astype(np.uint8)


def rarest(runs: np.ndarray, at: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the labelled words, with their rows, that come first in the order: one more than a
    fifth. Of two linked texts at least these have one in common, as all but a fifth of the words are."""
    sort = np.lexsort((runs, order[(runs >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], at))
    n = np.bincount(at, minlength=len(sizes))
    rank = np.arange(len(runs)) - np.repeat(np.cumsum(n) - n, n)
    take = sort[rank <= np.floor(sizes * (1 - SIMILARITY) + 1e-9)[at[sort]]]
    return runs[take], at[take]


def _rare(texts: DataFrame, order: np.ndarray) -> DataFrame:
    """node, n_words, label, bitmap, and tokens, the rarest words, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, runs, at in _each(batches):
            limits = np.searchsorted(at, np.arange(len(sizes) + 1))
            bits = pa.array([bitmap(runs[i:j], n).tobytes() for i, j, n in zip(limits[:-1], limits[1:], sizes.tolist(), strict=True)], pa.binary())
            first, rows = rarest(runs, at, sizes, order)
            cuts = np.searchsorted(rows, np.arange(len(sizes) + 1)).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(cuts), pa.array(first.view(np.int64)))
            held = [batch.column(c) for c in ("node", "n_words", "label")]
            yield pa.RecordBatch.from_arrays([*held, bits, tokens], names=["node", "n_words", "label", "bits", "tokens"])

    return texts.select("node", "n_words", "label", "words").mapInArrow(run, "node long, n_words int, label long, bits binary, tokens array<long>")


_CANDIDATE = "a long, b long, label_a long, label_b long, more long"


def _few(posts: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs of different classes that share the token of a small bucket and may be linked."""
    x, y = posts.alias("x"), posts.alias("y")
    met = x.join(y, "token").where((F.col("x.label") < F.col("y.label")) & _alike("x.n_words", "y.n_words"))
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    side = lambda c: rare.select(F.col("node").alias(c), *(F.col(d).alias(f"{d}_{c}") for d in ("label", "n_words", "bits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = np.full(batch.num_rows, -1)
            bits = [[np.frombuffer(w.as_buffer(), np.uint8) for w in batch.column(f"bits_{c}")] for c in "ab"]
            sizes = [batch.column(f"n_words_{c}").to_pylist() for c in "ab"]
            for i, (x, y, n, m) in enumerate(zip(*bits, *sizes, strict=True)):
                size = min(len(x), len(y))
                x, y = (_folded(z[None], size)[0] for z in (x, y))
                own, other = (int(np.bitwise_count(z).sum()) for z in (x & ~y, y & ~x))
                longest = max(n, m)
                more[i] = min(n - own, m - other) - (longest - int(longest * (1 - SIMILARITY) + 1e-9))
            held = [batch.column(c) for c in ("a", "b", "label_a", "label_b")]
            out = pa.RecordBatch.from_arrays([*held, pa.array(more)], names=["a", "b", "label_a", "label_b", "more"])
            yield out.filter(pa.array(more >= 0))

    return met.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, _CANDIDATE)


def _many(posts: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs of different classes that share the token of a full bucket and may be linked.

    Of buckets of the same texts one stands for all. A bucket is dealt into blocks: by length, each a
    quarter more than the one before, so that linked texts are in the same or the next; the largest class
    apart, as it need not be compared with itself; and evenly by hash. Of the tokens that a pair has in
    common the least gives it."""
    once = posts.groupBy("n", "texts").agg(F.min("token").alias("token")).select("token")
    weight = F.greatest("n_words", F.lit(LEAST_WORDS)).cast("long")
    crowds = materialise(posts.join(once, "token").select("token", "node", "n_words", "label", weight.alias("weight")), "crowds")
    classes = crowds.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    largest = classes.groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("weight").alias("all")).select("token", F.col("most.label").alias("largest"), "all")
    band = F.when(F.col("all") > 2 * BLOCK_WORDS, 1 + F.floor(F.log(F.greatest("n_words", F.lit(1))) / F.log(F.lit(1.26)))).otherwise(0).cast("int")
    apart = ((F.col("label") == F.col("largest")) & (F.col("all") > 2 * BLOCK_WORDS)).cast("int")
    dealt = crowds.join(largest, "token").select("token", "node", "weight", band.alias("band"), apart.alias("apart"))
    parts = materialise(dealt.groupBy("token", "band", "apart").agg(F.ceil(F.sum("weight") / BLOCK_WORDS).cast("int").alias("k")), "parts")
    parts = parts.withColumn("k", F.when(F.col("band") == 0, 1).otherwise(F.col("k")))
    at = F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int")
    own = dealt.join(parts, ["token", "band", "apart"]).select("token", "node", F.struct("band", "apart", at.alias("at")).alias("own"))
    others = parts.select("token", F.col("band").alias("band_2"), F.col("apart").alias("apart_2"), "k")
    near = (F.abs(F.col("own.band") - F.col("band_2")) <= 1) & (F.col("own.apart") + F.col("apart_2") < 2)
    met = own.join(others, "token").where(near).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    other = F.struct(F.col("band_2").alias("band"), F.col("apart_2").alias("apart"), "at")
    low, high = F.least("own", other).alias("low"), F.greatest("own", other).alias("high")
    met = met.select("token", "node", "own", low, high).withColumn("first", F.col("own") == F.col("low")).drop("own")

    def run(table: pa.Table) -> pa.Table:
        first = np.array(table.column("first").to_pylist(), bool)
        left = right = np.flatnonzero(first)
        if not first.all():
            right = np.flatnonzero(~first)
        bits = [np.frombuffer(w.as_buffer(), np.uint8) for w in table.column("bits")]
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        i, j, more = slack(bits, table.column("n_words").to_numpy(), left, right)
        i, j = left[i], right[j]
        swap = label[i] > label[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        keep = label[a] != label[b]
        if left is right:
            keep &= i < j
        a, b, more = a[keep], b[keep], more[keep]
        token = table.column("token")[0].as_py() if table.num_rows else 0
        before = [{t for t in own if t < token} for own in table.column("tokens").to_pylist()]
        keep = np.array([before[x].isdisjoint(before[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[keep], b[keep]
        return pa.table({"a": node[a], "b": node[b], "label_a": label[a], "label_b": label[b], "more": more[keep]})

    tokens = posts.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    grouped = met.join(rare.select("node", "n_words", "label", "bits").join(tokens, "node"), "node").groupBy("token", "low", "high")
    out = materialise(grouped.applyInArrow(run, _CANDIDATE), "candidates")
    discard(crowds, parts)
    return out


def _rest(crowds: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between labels of which texts are linked that are in full buckets, the same or not.

    crowds: node, n_words of texts in full buckets, a row for each bucket; labels: node, label of the
    classes so far. Texts of which none of the rarest words is shared are not linked; those that share one
    are judged by their bitmaps, and aligned if these allow a link: of two classes the most promising pair
    first, all others where that is not linked."""
    held = crowds.select("node", "n_words").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = materialise(held.join(texts, "node").select("node", "n_words", "label", "words"), "crowded")
    rare = materialise(_rare(held, _order(held)), "rare")
    posts = rare.select("node", "n_words", "label", F.explode("tokens").alias("token"))
    sets = posts.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("texts"), F.min("label").alias("low"), F.max("label").alias("high"))
    posts = materialise(posts.join(sets.where("low <> high").drop("low", "high"), "token"), "posts")
    many = _many(posts.where(F.col("n") > BUCKET), rare)
    found = _few(posts.where(F.col("n") <= BUCKET).drop("n", "texts"), rare).union(many)
    found = materialise(found.distinct(), "candidates")
    best = materialise(found.groupBy("label_a", "label_b").agg(F.max(F.struct("more", "a", "b")).alias("best")).select("best.a", "best.b", "label_a", "label_b"), "best")
    linked = materialise(_linked(best.select("a", "b"), held).join(best, ["a", "b"]).select("label_a", "label_b"), "linked")
    others = found.join(best, ["a", "b"], "left_anti").join(linked, ["label_a", "label_b"], "left_anti")
    further = _linked(others.select("a", "b"), held).join(found, ["a", "b"]).select("label_a", "label_b")
    out = materialise(linked.union(further).distinct().select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), "united")
    discard(held, rare, posts, many, found, best, linked)
    return out


def links(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and label of all nodes of similar texts: nodes of one class have one label.

    keyed: doc_id, key, text; nodes: node, key, doc_id (an id that has the text), n_words, sketches,
    remnants, places."""
    postings = nodes.select("node", F.col("n_words").cast("int"), F.posexplode("sketches").alias("place", "token"))
    members = materialise(_shared(postings), "buckets")
    # Growing sketches: the next tokens of the same kind, for texts in buckets that are too full.
    first = F.when(F.col("place") < SKETCHES, 0).otherwise(SKETCHES)
    count = F.when(F.col("place") < SKETCHES, SKETCHES).otherwise(SHORT_SKETCHES)
    following = F.transform(F.sequence(F.lit(1), F.lit(GROWTH[-1])), lambda d: F.get("sketches", (first + (F.col("place") - first + d) % count).cast("int")))
    full = members.where(F.col("n") > BUCKET).drop("n").join(nodes.select("node", "sketches"), "node")
    full = crowded = materialise(full.select("node", "n_words", "token", following.alias("following")), "full")
    levels = [members.drop("place")]
    for done, size in zip((0, *GROWTH[:-1]), GROWTH, strict=True):
        if not full.limit(1).count():
            break
        grown = full.withColumn("token", F.xxhash64("token", *(F.get("following", F.lit(d)) for d in range(done, size))))
        grown = materialise(_shared(grown), "grown")
        levels.append(grown.drop("following"))
        full = grown.where(F.col("n") > BUCKET).drop("n")
    # Short texts: the first text of each group is linked to the others, and stands for them.
    short = nodes.where(F.size("remnants") > 0).select("node", F.col("n_words").cast("int"), F.inline(F.arrays_zip("remnants", "places")))
    groups = materialise(short.groupBy("remnants", "places").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.min("n_words").alias("n_words")), "groups")
    copies = short.join(groups.where("n > 1").drop("n_words"), ["remnants", "places"]).select("node", F.col("first").alias("leader"))
    wanted = members.select("node").union(groups.select(F.col("first").alias("node"))).union(copies.select("node")).distinct()
    wanted = nodes.select("node", "key", "doc_id").join(wanted, "node", "left_semi")
    spot = F.concat("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = keyed.select(spot.alias("spot"), "text").join(wanted.select(spot.alias("spot"), "node"), "spot")
    texts = materialise(_hashed(found.dropDuplicates(["spot"])), "texts")
    again = _remainders(members, texts)
    met = reduce(DataFrame.unionByName, [*levels, *(x.drop("place") for x in again)])
    fullness = members.groupBy("node").agg(F.sum("n").alias("fullness"))
    leaders = met.join(fullness, "node").groupBy("token").agg(F.max(F.struct("fullness", "node", "n_words")).alias("leader"))
    led = met.join(leaders, "token").select("token", "node", "n_words", F.col("leader.node").alias("leader"), F.col("leader.n_words").alias("leader_words"), "n")
    kinds = groups.select(F.col("remnants").alias("token"), F.col("first").alias("node"), "n_words").distinct()
    kinds = _shared(kinds).select("token", "node", "n_words")
    lead = kinds.groupBy("token").agg(F.min(F.struct("node", "n_words")).alias("leader"))
    kinds = kinds.join(lead, "token").select("token", "node", "n_words", F.col("leader.node").alias("leader"), F.col("leader.n_words").alias("leader_words"), F.lit(0).alias("n"))
    led = materialise(led.unionByName(kinds).where("node <> leader"), "led")
    pairs = led.where(_alike("n_words", "leader_words")).select("node", "leader").union(copies)
    pairs = materialise(_paired(pairs, "node", "leader"), "pairs")
    near = materialise(_linked(pairs, texts), "linked")
    # Texts of small buckets that are not linked to the leader meet the others there.
    small = led.where(F.col("n") <= BUCKET)
    ends = small.withColumn("a", F.least("node", "leader")).withColumn("b", F.greatest("node", "leader"))
    apart = ends.join(near, ["a", "b"], "left_anti").select("token", "node", "n_words")
    x, y = apart.alias("x"), small.select("token", "node", "n_words").alias("y")
    crossed = x.join(y, "token").where((F.col("x.node") != F.col("y.node")) & _alike("x.n_words", "y.n_words"))
    crossed = _paired(crossed.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")), "x", "y").join(pairs, ["a", "b"], "left_anti")
    crossed = materialise(crossed, "crossed")
    edges = materialise(near.union(_linked(crossed, texts)), "links")
    labels = components(edges)
    crowds = reduce(DataFrame.unionByName, [x.where(F.col("n") > BUCKET).select("node", "n_words") for x in (members, *again)])
    more = _rest(crowds, labels, texts)
    ends = more.select("a").union(more.select("b")).distinct().select(F.col("a").alias("node"))
    joined = components(more)
    # Labels that were nodes without a link have one now.
    every = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    out = every.join(joined.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    out = materialise(out, "labels")
    discard(members, crowded, *levels[1:], *again, groups, led, pairs, texts, near, crossed, edges, labels, more, joined)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key and row (a number) of every row; class_id, the least id of its class; and stays,
    true for one row of each class."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", _key(F.col("text")))
    rows = materialise(_sketched(keyed).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # Null ids sort last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
    nodes = rows.groupBy("key").agg(first, *(F.any_value(c).alias(c) for c in ("n_words", "sketches", "remnants", "places")))
    nodes = materialise(nodes.withColumn("doc_id", F.col("first.doc_id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = links(keyed, nodes)
    label = F.coalesce("label", nodes.node)
    named = materialise(nodes.join(labels.withColumnRenamed("node", "at"), F.col("at") == F.col("node"), "left").select("key", "first", label.alias("label")), "named")
    best = named.groupBy("label").agg(F.min("first").alias("best"))
    judged = materialise(named.join(best, "label").select("key", "best"), "classes")
    out = rows.select("doc_id", "key", "row").join(judged, "key")
    discard(nodes, labels, named)
    return out.select("doc_id", "key", "row", F.col("best.doc_id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("stays"))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of the class) and kept (one row of each class), for every row."""
    return classes(docs).select("doc_id", "class_id", F.col("stays").alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns only."""
    key, best = fresh(docs, "text_key"), fresh(docs, "best_id")
    kept = classes(docs).where("stays").select(F.col("doc_id").alias(best), F.col("key").alias(key))
    marked = docs.withColumn(key, _key(F.coalesce(F.col("text"), F.lit(""))))
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"k.{best}")) & (F.col(f"d.{key}") == F.col(f"k.{key}"))
    joined = marked.alias("d").join(kept.alias("k"), on, "left_semi")
    return joined.dropDuplicates(["doc_id", key]).drop(key)
