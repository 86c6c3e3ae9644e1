"""Toxicity by non-negative positive-unlabelled learning.

A text is a set of hashed lower-case words; its value is the sum of learned word weights plus an
intercept. Only words clearly more common in positive than in unlabelled texts (likelihood-ratio
statistic above MIN_GAIN) get weights, which are trained on confirmed toxic texts (positives) and on
unlabelled texts, which are a mix of both kinds, with the risk estimator

    prior * R_positive(+1) + max(0, R_unlabelled(-1) - prior * R_positive(-1))

where the class prior is the share of toxic among the labelled training rows. When the second term
is negative, the step goes the other way (the non-negative correction). The logistic loss and Adam
are plain numpy on the driver, over a bounded sample: at most MAX_POSITIVE positive texts and
MAX_UNLABELLED of all training rows, those of least id hash, one text per id. Their words are counted
where they are, and only those that get weights come to the driver, however long the texts.
Everything is scored, by all words.

Labels come from training rows only; lang, source and doc_id are no features. Null and empty texts
have no words and get the score of the intercept. Repeated rows get equal scores. With no positive
labels at all, the weights stay zero and the scores equal the intercept's. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import blocks, string_parts, word_hashes, word_spans
from tessera.llm._spark import discard, fold, materialise, text_of

BITS = 18
MAX_POSITIVE = 4000
MAX_UNLABELLED = 12000
MIN_GAIN = 10.0
FOLDS, HELD_OUT = 4, 2
_CUT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of every row, as (row, feature) pairs in row order."""
    starts, ends, rows = word_spans(data, offsets, _CUT)
    words = word_hashes(data, starts, ends, lower=True) >> np.uint64(64 - BITS)
    pairs = np.unique(rows.astype(np.int64) << BITS | words.astype(np.int64))
    return pairs >> BITS, pairs & (1 << BITS) - 1


class Model:
    """Word weights and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def values(self, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[words], minlength=n) + self.intercept

    def scores(self, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.values(rows, words, n), -40, 40)))


def gains(in_p: np.ndarray, in_u: np.ndarray, p: int, u: int) -> np.ndarray:
    """Likelihood-ratio statistic of each word for being more common in positive texts, else 0, from
    the numbers of positive and unlabelled texts that have it, of p and u texts."""

    def likelihood(k: np.ndarray, n: int) -> np.ndarray:
        share = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (n - k) * np.log1p(-share)

    gain = 2 * (likelihood(in_p, p) + likelihood(in_u, u) - likelihood(in_p + in_u, p + u))
    return np.where(in_p * u > in_u * p, gain, 0)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 0, epochs: int = 25, batch: int = 512, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Non-negative PU learning of a linear model by Adam. Texts are arrays of distinct features."""
    model = Model(np.zeros(1 << BITS), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))))
    if not positive or not unlabelled:
        return model
    in_p, in_u = (np.bincount(np.concatenate(texts), minlength=1 << BITS) for texts in (positive, unlabelled))
    useful = gains(in_p, in_u, len(positive), len(unlabelled)) > MIN_GAIN
    positive, unlabelled = ([x[useful[x]] for x in texts] for texts in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    share = len(positive) / (len(positive) + len(unlabelled))
    steps = -(-(len(positive) + len(unlabelled)) // batch)
    size_p = max(8, round(batch * max(share, 0.25)))
    size_u = max(8, batch - size_p)
    first, second = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = np.zeros(2)
    t = 0
    for _ in range(epochs):
        for _ in range(steps):
            t += 1
            picked = [positive[i] for i in rng.integers(0, len(positive), size_p)] + [unlabelled[i] for i in rng.integers(0, len(unlabelled), size_u)]
            sizes = np.array([len(x) for x in picked])
            words = np.concatenate(picked)
            rows = np.repeat(np.arange(len(picked)), sizes)
            value = model.values(rows, words, len(picked))
            chance = 1 / (1 + np.exp(-np.clip(value, -40, 40)))
            is_p = np.arange(len(picked)) < size_p
            # Logistic loss: l(v, +1) = log(1 + exp(-v)) with slope chance - 1; l(v, -1) = log(1 + exp(v)) with slope chance.
            as_negative_loss = np.logaddexp(0, value)
            negative_risk = as_negative_loss[~is_p].mean() - prior * as_negative_loss[is_p].mean()
            as_negative = np.where(is_p, -prior / size_p, 1 / size_u) * chance
            if negative_risk < 0:
                gradient = -as_negative
            else:
                gradient = np.where(is_p, prior / size_p * (chance - 1), 0) + as_negative
            g = np.bincount(words, gradient[rows], minlength=1 << BITS) + decay * model.weights
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            model.weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            gb = gradient.sum()
            bias += (0.1 * (gb - bias[0]), 0.001 * (gb * gb - bias[1]))
            model.intercept -= rate * (bias[0] / (1 - 0.9**t)) / (np.sqrt(bias[1] / (1 - 0.999**t)) + 1e-8)
    return model


def _sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and all distinct words of one document for each of the given ids, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                rows, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                held = [words[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(held, pa.binary())], names=["doc_id", "words"])

    wanted = text_of(docs).join(F.broadcast(ids), "doc_id", "left_semi")  # the ids are a bounded sample
    return materialise(wanted.mapInArrow(run, "doc_id long, words binary").groupBy("doc_id").agg(F.min("words").alias("words")), "sample")


def _counts(sample: DataFrame) -> np.ndarray:
    """How many texts have each word; at most 2**BITS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for words in batch.column("words"):
                total[np.frombuffer(words.as_buffer(), "<u4")] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    out = np.zeros(1 << BITS, np.int64)
    for r in sample.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _useful_words(sample: DataFrame, useful: np.ndarray) -> list[np.ndarray]:
    """The useful words of every text, by id; the other words stay where they are."""
    packed = np.packbits(useful).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            each = [np.frombuffer(w.as_buffer(), "<u4") for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w[known[w]].tobytes() for w in each], pa.binary())], names=["doc_id", "words"])

    got = sample.select("doc_id", "words").mapInArrow(run, "doc_id long, words binary").collect()
    return [np.frombuffer(r["words"], dtype="<u4").astype(np.int64) for r in sorted(got, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = 0) -> Model:
    """Trains on rows outside the held-out fold."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit(seed))
    known = labels.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n, toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).head()
    prior = (toxic + 1) / (n + 2)
    sample = lambda df, k: spark.createDataFrame(df.orderBy(order).limit(k).collect(), "doc_id long")
    positives = sample(known.where("toxic = 1").select("doc_id").distinct(), max_positive)
    everyone = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    unlabelled = sample(everyone, max_unlabelled)
    kept = [_sampled(docs, ids) for ids in (positives, unlabelled)]
    p, u = (x.count() for x in kept)
    if p and u:
        useful = gains(*map(_counts, kept), p, u) > MIN_GAIN
        texts = [_useful_words(x, useful) for x in kept]
    else:
        texts = [[], []]
    discard(*kept)
    return train(*texts, prior, seed)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in blocks(offsets):
                rows, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                scores = shared.value.scores(rows, words, b - a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(scores)], names=["doc_id", "score"])

    return text_of(docs).mapInArrow(run, "doc_id long, score double")


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return score_documents(docs, fit(docs, labels)).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
