"""Target-distribution importance resampling: documents drawn without replacement in favour of a target's features.

Features are runs of one and two words, hashed to buckets. Two counts of buckets, of all documents and of the target,
give every bucket a gain, an array of `BUCKETS` numbers that travels with the task; a document's weight is the mean gain of
its features. To the weight comes a Gumbel number from the document's id, so the largest scores are a draw by weight.

The draw is exact and needs no sort of all rows: a radix selection on the digits of (score, doc_id, row) counts one digit
at a time among rows that share the digits before it, at most `2 ** DIGIT_BITS` counts for each, until the k-th key is
known. Only drawn rows are sorted, range by range, and ranked.

Cases: a null or empty text has no features and weight 0; a row whose id is null has no score, is not counted among the
eligible and is never drawn; rows that repeat an id count each, ranks among equal (score, doc_id) are given in an
arbitrary order, each rank once; empty documents give an empty table; an empty target counts 0 in every bucket; further
columns are not read. Whole texts of any length are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, numbered, read_table, slices, written

BUCKETS = 10_000
#: A document is eligible from so many words; so many of 100 eligible ones are drawn; the seed of the Gumbel numbers.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bits of a digit of the radix selection: 2 ** DIGIT_BITS counts reach the driver at once at most.
DIGIT_BITS = 12

SCORED = "doc_id long, n_words long, n_features long, weight long"

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of ASCII letters and digits and of all that is not ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def feature_buckets(found: list[bytes]) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours; a pair's crc goes on from its first word's."""
    n = len(found)
    if not n:
        return np.empty(0, np.int64)
    single = np.fromiter(map(crc32, found), np.int64, n)
    spaced = map(crc32, repeat(b" "), single[:-1].tolist())
    pairs = np.fromiter(map(crc32, found[1:], spaced), np.int64, n - 1)
    return np.concatenate((single, pairs)) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column `text` fall in each bucket: summed in each task first, `BUCKETS` numbers in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total += np.bincount(feature_buckets(words(text)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of a bucket's shares in target and source)."""
    all_source, all_target = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = lambda s, t: (float(t + 1) * float(all_source)) / (float(s + 1) * float(all_target))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, weights = [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                buckets = feature_buckets(found)
                counts.append((len(found), len(buckets)))
                weights.append(int(gains[buckets].sum()) // len(buckets) if len(buckets) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array(weights, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return id_and_text(docs).mapInArrow(run, SCORED)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) with u in (0, 1) from the seed and the id."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    u = (F.conv(first, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def kth_key(rows: DataFrame, parts: list[str], k: int):
    """The k-th smallest (k >= 1) of the rows' keys, a struct of whole numbers `parts` that no two rows share; None if there are fewer."""
    if k < 1:
        return None
    bounds = rows.agg(*[f(p).alias(f"{p}_{f.__name__}") for p in parts for f in (F.min, F.max)]).first()
    kept, left = rows, k
    for p in parts:
        low, high = bounds[f"{p}_min"], bounds[f"{p}_max"]
        if low is None:
            return None
        for shift in reversed(range(0, (high - low).bit_length(), DIGIT_BITS)):
            digit = F.shiftright(F.col(p) - low, shift).bitwiseAND(2**DIGIT_BITS - 1)
            counts = sorted((r["digit"], r["n"]) for r in kept.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
            for value, n in counts:
                if n >= left:
                    break
                left -= n
            else:
                return None
            kept = kept.where(digit == value)
            if n == left:  # all of these rows are taken
                return kept.agg(F.max(F.struct(*parts)).alias("key")).first()["key"]
    return kept.agg(F.max(F.struct(*parts)).alias("key")).first()["key"]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank counts the drawn from 1, others have none."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gains).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored").withColumn("under", -F.col("score"))
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    key = ["under", "doc_id", "row"]
    last = kth_key(scored.where(eligible).select(*key), key, percent * scored.where(eligible).count() // 100)
    drawn = F.lit(False) if last is None else eligible & (F.struct(*key) <= F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in key]))
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(scored.where(drawn), *key).select(*out, (F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark's texts."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
