"""Language-model scores by deleted interpolation.

A bigram model of lower-cased words with one end token per text:

    P(w | h) = l2[b] * c(h w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)

b is the bucket of the context's frequency, floor(log2(c(h) + 1)); unseen contexts have a bucket
of their own. A tenth of the training texts is deleted from the counts; on it, expectation-
maximisation learns the weights of each bucket from held-out counts. The final model counts all
training texts. Counts cover the whole corpus and live in Spark: n-grams are made distinct within
chunks of some megabytes, added up in parts by hash, and sent back to the chunks that hold them.
The driver sees only the held-out counts binned by frequency, a table whose size is bounded by the
bins, and learns the weights there.

The order is two: with three, the keys that travel exceed the disk allowed for it (see README).
Null and empty texts are one end token. Null ids count as training texts by their fold. Repeated
rows count and score each for itself. Without training texts all probabilities are l0 / (V + 1).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import blocks, mix, word_hashes, word_spans
from tessera.llm._chunks import ASKED, Chunk, answer, ask, batch_of, distinct, pack, packed_rows, parts_for, read_answers, unpack
from tessera.llm._spark import materialise

FOLDS, HELD_OUT = 7, 2
DELETED_SHARE = 10
FIT, DELETED, UNSEEN = 0, 1, 2
BUCKETS = 34
STEPS_PER_OCTAVE = 4
BIGRAM_BYTES = 6
_END, _BEGIN = np.uint64(0x51AFD7ED558CCD25), np.uint64(0x2545F4914F6CDD1D)
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def role(doc_id: int | None) -> int:
    """Whether a text is counted, deleted from the counts to learn weights, or not for training."""
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if crc % FOLDS == HELD_OUT:
        return UNSEEN
    return DELETED if crc // FOLDS % DELETED_SHARE == 0 else FIT


@dataclass
class Tokens:
    """Hashed tokens of a chunk with an end after every text, and their sorted distinct n-grams."""

    rows: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    before_at: np.ndarray


def tokens_of(chunk: Chunk) -> Tokens:
    hashes, rows = [], []
    for a, b in blocks(chunk.offsets):
        data, offsets = chunk.data[chunk.offsets[a] : chunk.offsets[b]], chunk.offsets[a : b + 1] - chunk.offsets[a]
        starts, ends, row = word_spans(data, offsets)
        hashes.append(word_hashes(data, starts, ends, lower=True))
        rows.append(row + a)
    word, row = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *rows])
    n = len(chunk.ids)
    stream = np.full(len(word) + n, _END, dtype=np.uint64)
    stream[np.arange(len(word)) + row] = word
    counts = np.bincount(row, minlength=n) + 1
    row = np.repeat(np.arange(n), counts)
    first = np.cumsum(counts) - counts
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[first] = _BEGIN
    grams, gram_at = distinct(mix(before * np.uint64(0x9E3779B97F4A7C15) + (stream ^ stream >> np.uint64(32)), 2))
    words, word_at = distinct(stream)
    before_at = np.empty_like(word_at)
    before_at[1:] = word_at[:-1]
    before_at[first] = -1
    return Tokens(row, words, word_at, grams, gram_at, before_at)


def _requests(rows: DataFrame, parts: int) -> DataFrame:
    """Words (kind 0) and bigrams (kind 1) of each chunk with their counts in counted and deleted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in packed_rows(batch):
                t = tokens_of(unpack(packed))
                for kind, keys, at, width in ((0, t.words, t.word_at, 8), (1, t.grams, t.gram_at, BIGRAM_BYTES)):
                    counts = np.zeros((len(keys), 2), np.int64)
                    if packed["kind"] != UNSEEN:
                        counts[:, packed["kind"]] = np.bincount(at, minlength=len(keys))
                    out = ask(packed["chunk"], keys, counts, parts, width)
                    yield batch_of([x | {"part": x["part"] * 2 + kind} for x in out], ASKED)

    return rows.mapInArrow(run, ASKED)


def _lookup(chunk: Chunk, answers: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens of a chunk, with the counts (in counted, in deleted texts) of its words and bigrams."""
    t = tokens_of(chunk)
    bigram = np.array(answers.column("part").to_pylist(), dtype=np.int64) % 2 == 1
    words, grams = (read_answers(answers.filter(pa.array(bigram == flag)), 2) for flag in (False, True))
    if words.shape[1] != len(t.words) or grams.shape[1] != len(t.grams):
        raise ValueError("answers and keys of a chunk differ")
    return t, words, grams


def _contexts(t: Tokens, word_counts: np.ndarray) -> np.ndarray:
    """Count of each token's context; a text's begin is as frequent as the end."""
    ends = word_counts[np.searchsorted(t.words, _END)]
    return np.where(t.before_at < 0, ends, word_counts[t.before_at])


def _bucket(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(contexts + 1).astype(np.int64), BUCKETS - 1)


def _held_out_counts(chunks: DataFrame, answers: DataFrame, tokens: int) -> np.ndarray:
    """Deleted tokens binned by context bucket, c(h)/c(h w) and N/c(w): rows of (bucket, i, j, n).

    The ratios are binned in quarter octaves, so there are at most 34 * 130 * 260 rows."""

    def bins(total: np.ndarray | int, count: np.ndarray) -> np.ndarray:
        ratio = np.log2(np.maximum(total, 1) / np.maximum(count, 1)) * STEPS_PER_OCTAVE
        return np.where(count > 0, np.round(ratio).astype(np.int64) + 1, 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in packed_rows(left):
            t, words, grams = _lookup(unpack(packed), right)
            contexts = _contexts(t, words[0])
            cell = _bucket(contexts) << 32 | bins(contexts, grams[0][t.gram_at]) << 16 | bins(tokens, words[0][t.word_at])
            keys, at = distinct(cell)
            out += [{"cell": int(k), "n": int(n)} for k, n in zip(keys, np.bincount(at, minlength=len(keys)), strict=True)]
        return pa.Table.from_batches([batch_of(out, "cell long, n long")])

    deleted = chunks.where(F.col("kind") == DELETED)
    counted = deleted.groupBy("chunk").cogroup(answers.join(deleted.select("chunk"), "chunk", "left_semi").groupBy("chunk")).applyInArrow(run, "cell long, n long")
    got = counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.array([r["cell"] for r in got], dtype=np.int64)
    return np.stack([cells >> 32, cells >> 16 & 0xFFFF, cells & 0xFFFF, np.array([r["n"] for r in got], dtype=np.int64)], axis=1).reshape(-1, 4)


def learn_weights(held_out: np.ndarray, words: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket by expectation-maximisation. A bucket without
    held-out counts takes the weights of all; an unseen context has no bigram part."""

    def em(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([np.where(rows[:, i] > 0, 2.0 ** (-(rows[:, i] - 1) / STEPS_PER_OCTAVE), 0.0) for i in (1, 2)] + [np.full(len(rows), 1 / (words + 1))], axis=1)
        weights = start
        for _ in range(rounds):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = (share * rows[:, 3:]).sum(axis=0)
            weights = np.maximum(weights / weights.sum(), 1e-6)
            weights = weights / weights.sum()
        return weights

    overall = em(held_out, np.full(3, 1 / 3)) if len(held_out) else np.full(3, 1 / 3)
    out = np.tile(overall, (BUCKETS, 1))
    for b in np.unique(held_out[:, 0]).tolist() if len(held_out) else []:
        out[b] = em(held_out[held_out[:, 0] == b], overall)
    out[0, 1:] += out[0, 0] / 2
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    chunks = pack(docs, lambda ids: np.array([role(x) for x in ids.to_pylist()], dtype=np.int64))
    answers = materialise(answer(_requests(chunks, parts_for(chunks)), 2, (8, BIGRAM_BYTES)), "answers")
    facts = answers.where("chunk = -1 AND part % 2 = 0").select("answers").collect()  # one row per part
    fit_tokens, deleted_tokens, words = np.sum([np.frombuffer(r["answers"], "<i8") for r in facts], axis=0).tolist() if facts else (0, 0, 0)
    n = fit_tokens + deleted_tokens
    weights = learn_weights(_held_out_counts(chunks, answers, fit_tokens), words)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in packed_rows(left):
            chunk = unpack(packed)
            t, word_counts, gram_counts = _lookup(chunk, right)
            word_counts, gram_counts = word_counts.sum(axis=0), gram_counts.sum(axis=0)
            contexts, counts = _contexts(t, word_counts), word_counts[t.word_at]
            mixed = weights[_bucket(contexts)]
            chance = mixed[:, 0] * gram_counts[t.gram_at] / np.maximum(contexts, 1) + mixed[:, 1] * counts / max(n, 1) + mixed[:, 2] / (words + 1)
            rows = len(chunk.ids)
            add = lambda x: np.bincount(t.rows, x, minlength=rows)  # noqa: E731, B023
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        chunk.id_array(),
                        pa.array(np.full(rows, packed["kind"] == UNSEEN)),
                        pa.array(np.bincount(t.rows, minlength=rows)),
                        pa.array(add(counts > 0).astype(np.int64)),
                        pa.array(np.full(rows, n, dtype=np.int64)),
                        pa.array(add(np.log10((counts + 1) / (n + words + 1)))),
                        pa.array(add(np.log10(chance))),
                    ],
                    names=[x.split()[0] for x in _SCORED.split(", ")],
                )
            )
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([batch_of([], _SCORED)])

    return chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(run, _SCORED)
