"""Line dedup by pairwise alignment of overlapping documents.

Documents overlap if they share a run of consecutive lines that has just MIN_BLOCK_WORDS words,
counted from its first or its last line; a line with so many words is a run of its own. Every
block that can go consists of such runs. Each pair is aligned by patience diff on line hashes;
aligned common blocks (consecutive lines in both) of at least MIN_BLOCK_WORDS words are deleted
from the later document. A later copy of a whole text is one common block. All judging is on the
input, and earlier means a smaller doc_id (null last).

Through rare runs, held by at most RARE different texts, every holder meets every earlier one. A
more common run leads each holder to the earliest one; holders with lines of the run that have not
gone by then meet the next four holders, then the next sixteen, and so on, until the lines are gone
or all earlier holders met. So the result is that of aligning all documents that overlap.

Codepoints of scripts written without spaces (Chinese, Japanese, Thai and others) count as words.

Lines are compared without surrounding white space; blank lines are never deleted alone. Null and
empty texts stay as they are, and an empty table gives no rows. Extra columns pass through, whatever
their names. Rows that repeat with id and text are the same document and get the
same result. Only lines that occur in several texts travel, as hashes; texts move once, to meet
the numbers of their deleted lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import mix
from tessera.llm._spark import fresh, materialise
from tessera.llm.near_dups import _key

RARE = 8
MIN_BLOCK_WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"
# Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_COUNTED = rf"[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]+"
_WHITE = " \t\n\x0b\x0c\r"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first number, whose second numbers rise."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences: lines unique in both anchor the match, which grows from
    the ends of each stretch between anchors, again by patience."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, i_end, j, j_end = work.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {x: k for k, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        anchors = _rising([(k, where[x]) for k, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in where])
        if not anchors:
            continue
        edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        out += anchors
        work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True) if p + 1 < q and r + 1 < s]
    return sorted(out)


def common_blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Line numbers of the later text in common blocks. Lines: (number, hash[, words]); lines of no
    other text are left out of both lists, so numbers tell which lines are consecutive."""
    gone, block, words = [], [], 0
    last = None
    for i, j in patience([x[1] for x in later], [x[1] for x in earlier]):
        here = (later[i][0], earlier[j][0])
        if last is None or here != (last[0] + 1, last[1] + 1):
            if words >= least:
                gone += block
            block, words = [], 0
        block.append(here[0])
        words += later[i][2]
        last = here
    return gone + block if words >= least else gone


def _runs(texts: DataFrame) -> DataFrame:
    """key, first, hash, number of the first line and length of every run of lines that has
    MIN_BLOCK_WORDS words, but not without its first or not without its last line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("lines")
            hashes, words = (np.asarray(x) for x in lines.flatten().flatten())
            hashes = hashes.view(np.uint64)
            sizes = np.asarray(lines.value_lengths()).astype(np.int64)
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            last = np.repeat(ends, sizes)
            counts, blanks = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (words, words == 0))
            found = []
            for n in range(1, MIN_BLOCK_WORDS + 1):
                at = np.arange(len(row))
                at = at[at + n <= last]
                total = counts[at + n] - counts[at]
                less = np.minimum(total - words[at], total - words[at + n - 1])
                at = at[(total >= MIN_BLOCK_WORDS) & (less < MIN_BLOCK_WORDS) & (blanks[at + n] == blanks[at])]
                value = hashes[at]
                for k in range(1, n):
                    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k], k)
                found.append((row[at], value.view(np.int64), at - (ends - sizes)[row[at]], np.full(len(at), n)))
            rows, value, number, length = (np.concatenate(x) for x in zip(*found, strict=True))
            held = [batch.column(c).take(pa.array(rows)) for c in ("key", "null", "doc_id")]
            yield pa.RecordBatch.from_arrays([held[0].cast(pa.binary()), *held[1:], *(pa.array(x) for x in (value, number, length))], names=["key", "null", "doc_id", "hash", "number", "length"])

    flat = texts.select("key", "first.null", "first.doc_id", "lines")
    made = flat.mapInArrow(run, "key binary, null boolean, doc_id long, hash long, number long, length long")
    return made.select("hash", F.struct(F.struct("null", "doc_id").alias("first"), "key").alias("holder"), "number", "length")


def _aligned(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """key of the later text of each pair, and the numbers of its lines to delete, where there are some."""
    joined = pairs.join(kept.select(F.col("key").alias("later"), F.col("lines").alias("later_lines")), "later")
    joined = joined.join(kept.select(F.col("key").alias("earlier"), F.col("lines").alias("earlier_lines")), "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                later, earlier = ([[tuple(x.values()) for x in row] for row in part.column(c).to_pylist()] for c in ("later_lines", "earlier_lines"))
                gone = [common_blocks(a, b) for a, b in zip(later, earlier, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("later").cast(pa.binary()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    return joined.select("later", "later_lines", "earlier_lines").mapInArrow(run, "key binary, gone array<int>").where(F.size("gone") > 0)


def deleted_lines(keyed: DataFrame) -> DataFrame:
    """key, rep (the least id with the text) and the sorted numbers of its lines to delete.

    keyed: doc_id, key, text without nulls."""
    lines = F.split("text", "\n")
    counted = keyed.select(
        "key", F.col("doc_id"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(_WHITE))).alias("hash"), F.regexp_count(x, F.lit(_COUNTED)).alias("words"))).alias("lines"),
    )
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")
    texts = materialise(counted.groupBy("key").agg(F.min(order).alias("first"), F.any_value("lines").alias("lines")), "lines")
    spread = texts.select("key", F.posexplode("lines").alias("number", "line")).select("key", "number", "line.*").where("words > 0")
    runs = _runs(texts)
    held = runs.select("hash", "holder").distinct()
    shared = held.groupBy("hash").agg(F.count("*").alias("holders"), F.min("holder").alias("leader")).where("holders > 1")
    shared = materialise(shared, "shared")
    posts = materialise(held.join(shared, "hash"), "posts")
    rare = posts.where(F.col("holders") <= RARE).select("hash", "holder")
    meet = rare.alias("x").join(rare.alias("y"), "hash").where("x.holder > y.holder").select(F.col("x.holder.key").alias("later"), F.col("y.holder.key").alias("earlier"))
    led = posts.where((F.col("holders") > RARE) & (F.col("holder") > F.col("leader"))).select(F.col("holder.key").alias("later"), F.col("leader.key").alias("earlier"))
    pairs = materialise(meet.union(led).distinct(), "pairs")
    # Lines of several texts, long or short: what an alignment can match.
    several = spread.groupBy("hash").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("hash")
    kept = spread.join(several, "hash").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "hash", "words"))).alias("lines"))
    kept = materialise(kept, "kept")
    gone = materialise(_aligned(pairs, kept), "gone")
    # Common runs whose lines have not all gone: their holders meet further ones.
    last = shared.where(F.col("holders") > RARE).select("hash", F.col("leader").alias("last"))
    common = runs.join(last, "hash").where(F.col("holder") > F.col("last")).select("hash", "holder", F.explode(F.sequence("number", F.col("number") + F.col("length") - 1)).alias("number"))
    deleted = gone.select("key", F.explode("gone").alias("number")).distinct()
    waiting = common.join(deleted, (F.col("holder.key") == F.col("key")) & (common["number"] == deleted["number"]), "left_anti").select("hash", "holder", "number").distinct()
    waiting, tried, most = materialise(waiting, "waiting"), pairs, 4
    while waiting.limit(1).count():
        ahead = posts.join(waiting.select("hash").distinct(), "hash", "left_semi").join(last, "hash").where(F.col("holder") > F.col("last"))
        number = F.row_number().over(Window.partitionBy("hash").orderBy("holder"))
        leaders = materialise(ahead.select("hash", "holder", number.alias("place")).where(F.col("place") <= most).select("hash", F.col("holder").alias("leader")), "leaders")
        led = waiting.select("hash", "holder").distinct().join(leaders, "hash").where(F.col("holder") > F.col("leader"))
        pairs = led.select(F.col("holder.key").alias("later"), F.col("leader.key").alias("earlier")).distinct().join(tried, ["later", "earlier"], "left_anti")
        pairs = materialise(pairs, "pairs")
        found = materialise(_aligned(pairs, kept), "gone")
        tried, gone = tried.union(pairs), gone.union(found)
        last = materialise(leaders.groupBy("hash").agg(F.max("leader").alias("last")), "last")
        # A holder behind the last leader has met all earlier ones.
        deleted = found.select("key", F.explode("gone").alias("number")).distinct()
        behind = waiting.join(last, "hash").where(F.col("holder") > F.col("last")).select("hash", "holder", "number")
        left = behind.join(deleted, (F.col("holder.key") == F.col("key")) & (behind["number"] == deleted["number"]), "left_anti")
        waiting, most = materialise(left, "waiting"), most * 4
    numbers = gone.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("numbers"))
    return texts.select("key", F.col("first.doc_id").alias("rep")).join(numbers, "key", "left")


def _trimmed(text: str, numbers: list[int] | None, copy: bool) -> tuple[str, int, int]:
    """The text without the deleted lines, its number of lines with a word, and how many went."""
    lines = text.split("\n")
    filled = [bool(x.strip(_WHITE)) for x in lines]
    n = sum(filled)
    if copy and len(re.findall(_COUNTED, text)) >= MIN_BLOCK_WORDS:
        return "", n, n
    if not numbers or copy:
        return text, n, 0
    gone = set(numbers)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), n, len(gone)


def trim_documents(docs: DataFrame, n_lines: str, n_removed: str) -> DataFrame:
    """The documents with deleted lines gone from `text`, and two columns of counts."""
    key, rep, numbers = (fresh(docs, x) for x in ("text_key", "first_id", "gone_lines"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", _key(F.col("text")))
    deleted = materialise(deleted_lines(keyed), "deleted").select(F.col("key").alias(key), F.col("rep").alias(rep), F.col("numbers").alias(numbers))
    joined = docs.withColumn(key, _key(text)).join(deleted, key, "left")
    copy = fresh(joined, "is_copy")
    joined = joined.withColumn(copy, ~F.col("doc_id").cast("long").eqNullSafe(F.col(rep)))
    columns = [*docs.columns, n_lines, n_removed]
    schema = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.lit(0).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_removed)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [_trimmed(t or "", g, c) for t, g, c in zip(texts, batch.column(numbers).to_pylist(), batch.column(copy).to_pylist(), strict=True)]
            new = {
                "text": pa.array([None if t is None else m[0] for t, m in zip(texts, made, strict=True)], batch.schema.field("text").type),
                n_lines: pa.array([m[1] for m in made], pa.int64()),
                n_removed: pa.array([m[2] for m in made], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c) if c in batch.schema.names else None) for c in columns], names=columns)

    kept = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, numbers, copy).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what is kept, one row per document."""
    out = trim_documents(docs.select("doc_id", "text"), "n_lines", "n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated blocks, with their own columns only. A document of which no
    word is left goes: earlier documents hold all of it."""
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = trim_documents(docs, n_lines, n_removed)
    emptied = (F.col(n_removed) > 0) & ~F.col("text").rlike(WORD)
    return out.where(~F.coalesce(emptied, F.lit(False))).drop(n_lines, n_removed)
