"""Quality scores by positive-unlabelled learning.

The model sees trusted positives, unlabelled web text and a class prior; it never sees a labelled negative. It minimises
the non-negative unbiased risk  prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])  with the logistic loss, so
that the logistic function of f estimates the chance of label 1. f is a network with one hidden layer over features of the
text alone.

The prior is estimated from positives and unlabelled texts alone (`class_prior`): above any score, unlabelled texts hold at
least prior times the share of positives that score so, and nearly no more where only positives score so high. So a first
network is fitted on one half of both, and on the other halves the ratio of the two shares is taken at the score where its
upper bound is least. The prior is the mean over several splits; the least of them was too low on small tables, and a
prior that is too low rejects good documents.

At most `SAMPLE` trusted positives and `SAMPLE` unlabelled texts fit the model, those with the least hashes of their
ids (of an id with several rows one counts); every text is scored. With fewer than `FEWEST` of either the prior is 0.5;
without a trusted positive, all scores are the prior.

Cases: null and empty texts are scored from their features, all zero; rows with a null id are scored and not held out;
repeated rows are scored each; an empty table gives an empty table; further columns are not read. An id with several
labels counts as each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, read_table, slices

SAMPLE = 8_000
HIDDEN = 16
ROUNDS = 400
#: Splits that the prior is estimated on, rounds of a split's network, and rows of a side below which there is no estimate.
SPLITS, SPLIT_ROUNDS, FEWEST = 6, 200, 20
FOLDS = 5
KEEP_FROM = 0.3

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t", b".", b",;:", b"!", b"?", b"|", b"#$%&*@^~", b"<>{}[]()", b"\\/=+_-", b"'\"`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_CLASSES) + 1
FEATURES = len(_CLASSES) + 2 + 11


def features(text: str) -> np.ndarray:
    """What a whole text looks like: shares of character classes on a log scale, repetition of words and lines, lengths."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=len(_CLASSES) + 2) / len(data)
    k = len(share)
    out[:k] = np.log(share + 1e-3) - np.log(1e-3)
    words = text.split()
    n = len(words)
    if n:
        distinct = len(set(words))
        out[k] = sum(map(eq, words, islice(words, 1, None))) / n  # a word just after itself
        out[k + 1] = sum(map(eq, words, islice(words, 2, None))) / n
        out[k + 2] = distinct / n
        out[k + 3] = np.log(distinct) / np.log(n + 1)
        out[k + 4] = np.log1p(n)
        out[k + 5] = min(20.0, (len(text) - n) / n) / 5
        out[k + 6] = min(2.0, (share[1] * len(data)) / n)  # capitals per word
        out[k + 7] = min(2.0, (share[11] * len(data)) / n)  # symbols per word
    lines = text.split("\n")
    out[k + 8] = len(set(lines)) / len(lines)
    out[k + 9] = np.log1p(len(text) / len(lines)) / 5
    out[k + 10] = share[1] / (share[0] + share[1] + 1e-6)
    return out


class Model:
    """A network with one hidden layer on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def gradient(self, z: np.ndarray, h: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
        back = np.outer(df, self.p[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ df, np.array([df.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.standard(x))[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = 1e-3) -> Model:
    """Adam on the non-negative risk; where the unlabelled part is negative, a step back along its gradient instead."""
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(0), both.std(0) + 1e-3)
    zp, zu = model.standard(positive), model.standard(unlabelled)
    first = [np.zeros_like(p) for p in model.p]
    second = [np.zeros_like(p) for p in model.p]
    for step in range(1, rounds + 1):
        (hp, fp), (hu, fu) = model.forward(zp), model.forward(zu)
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rest_p, rest_u = -prior * sp / len(sp), su / len(su)
        if negative_risk >= 0:
            grads = [a + b for a, b in zip(model.gradient(zp, hp, prior * (sp - 1) / len(sp) + rest_p), model.gradient(zu, hu, rest_u))]
        else:
            grads = [-(a + b) for a, b in zip(model.gradient(zp, hp, rest_p), model.gradient(zu, hu, rest_u))]
        rate = 0.02 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for i, g in enumerate(grads):
            g = g + decay * model.p[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            model.p[i] = model.p[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, splits: int = SPLITS, chance: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, at most; see the module."""
    if min(len(positive), len(unlabelled)) < FEWEST:
        return 0.5
    found = []
    for seed in range(splits):
        rng = np.random.default_rng(seed)
        p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
        model = train(p[: len(p) // 2], u[: len(u) // 2], 0.5, SPLIT_ROUNDS)
        sp, su = np.sort(model.scores(p[len(p) // 2 :])), np.sort(model.scores(u[len(u) // 2 :]))
        of_p, of_u = 1 - np.searchsorted(sp, sp) / len(sp), 1 - np.searchsorted(su, sp) / len(su)  # that score as high as each positive
        slack = sum(np.sqrt(np.log(4 / chance) / (2 * len(s))) for s in (sp, su))
        best = int(((of_u + slack) / of_p).argmin())
        found.append(of_u[best] / of_p[best])
    return float(min(0.98, max(0.02, np.mean(found))))


def fold_of(key: str) -> F.Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def _sampled_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with these ids. ids: SAMPLE rows at most, so they are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(text).tolist() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    every = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<float>")
    rows = every.groupBy("doc_id").agg(F.min("x").alias("x")).collect()  # as many as there are ids, however often one repeats
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return np.array([r.x for r in rows], np.float64).reshape(len(rows), FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """The model and the class prior, from rows outside the held-out fold."""
    docs = id_and_text(docs)
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(fold_of("doc_id") != 0)
    least = F.xxhash64("doc_id")
    positive = trusted.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct().orderBy(least, "doc_id").limit(sample)
    unlabelled = docs.select("doc_id").where(fold_of("doc_id") != 0).distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    p, u = _sampled_features(docs, positive), _sampled_features(docs, unlabelled)
    prior = class_prior(p, u)
    if not len(p) or not len(u):
        return None, prior
    return train(p, u, prior), prior


def score(docs: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """doc_id and the score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            x = np.array([features(text) for text in texts], np.float64).reshape(len(texts), FEATURES)
            got = model.scores(x) if model else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, prior: float, least: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `least` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(text or "") for text in batch.column(at).to_pylist()], np.float64).reshape(batch.num_rows, FEATURES)
            got = model.scores(x) if model else np.full(batch.num_rows, prior)
            yield batch.filter(pa.array(got >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, its fold and its prediction."""
    docs = read_table(spark, sf_dir, "documents")
    model, prior = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, prior).select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted")
    )
