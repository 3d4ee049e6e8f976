"""What the corpus operators share: table access, the shared folder, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shingles of near-duplicate operators: words in one shingle, least similarity in percent.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that further columns can clash with nothing; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, one of our own if all runs in one
    process, and an error on a cluster, whose machines share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps reread it, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- words and shingles -------------------------------------------------------------------------

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_CACHE_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words (bytes), computed once for each word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of what is not x20 or x09 to x0D; bytes.lower and bytes.split do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sequence(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; none where there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out ^= words[i : i + n]
        out *= _MIX[i % 5]
        out ^= out >> np.uint64(29)
    out *= _MIX[0]
    out ^= out >> np.uint64(32)
    return out


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than five words count as one shingle, no word as none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return np.unique(shingle_sequence(hashes.array(words)))


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return values.view(np.int64)


# ---- rows in order, rows in batches --------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, without copies. Spark bounds a batch by bytes, a slice bounds what is unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_range_bucket(df: DataFrame, key: str, buckets: int, name: str = "bucket") -> tuple[DataFrame, list[int]]:
    """A column that deals rows to `buckets` consecutive ranges of an integer key, and the ranges' upper ends.

    The ends are values of the key; a range holds what is above the end before it, up to its own end. The first
    range takes null keys, the last what is above all ends. Only the key is read for the ends, and only they reach the driver.
    """
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        found = df.select(F.percentile_approx(key, at, 100 * buckets).alias("ends")).first()["ends"]
    else:
        found = None
    ends = sorted(set(found or []))
    if not ends:
        return df.withColumn(name, F.lit(0)), ends
    return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(0)).otherwise(_ends_below(F.col(key), ends))), ends


def _ends_below(key: Column, ends: list[int]) -> Column:
    """How many of the ascending ends are below the key: by groups of ends first, then inside one group."""
    group = max(1, int(len(ends) ** 0.5))
    as_array = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    below = lambda array: F.aggregate(array, F.lit(0), lambda n, x: n + (x < key).cast("int"))
    groups = F.greatest(below(as_array(ends[::group])), F.lit(1))  # groups whose first end is below; the last of them is looked into
    return (groups - 1) * group + below(F.slice(as_array(ends), (groups - 1) * group + 1, group))


def with_ordered_part(df: DataFrame, key: str, tie: Column, parts: int, name: str = "part") -> DataFrame:
    """A column that deals rows to `parts` numbered ranges of an integer key, as even as the key's own counts are known.

    A key that fills several ranges by itself is split over them by `tie`, a hash. Null keys are the least.
    """
    least = F.coalesce(F.col(key), F.lit(-(2**63)))
    ends: list[int] = []
    if parts > 1:
        ends = sorted(df.select(F.percentile_approx(least, [i / parts for i in range(1, parts)], 100 * parts).alias("ends")).first()["ends"] or [])
    if not ends:
        return df.withColumn(name, F.lit(0))
    distinct = sorted(set(ends))
    before = [0]
    for end in distinct:
        before.append(before[-1] + ends.count(end))
    below = _ends_below(least, distinct)
    firsts = F.array(*[F.lit(x) for x in [*before, before[-1] + 1]])
    first, end = F.get(firsts, below), F.get(F.array(*[F.lit(x) for x in distinct]), below)
    many = F.when(end == least, F.get(firsts, below + 1) - first).otherwise(1)
    return df.withColumn(name, (first + F.pmod(tie, many)).cast("int"))


_ROW_BITS = 33  # of monotonically_increasing_id: the row inside its partition; above them the partition


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place (0, 1, 2 ...) in this order.

    Rows are dealt to ranges, sorted there and written with their place in their range; only the ranges' row counts, as
    many as there are shuffle partitions, reach the driver. The order is sampled before rows are dealt, so df should be
    cheap to read twice (a written table).
    """
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered")
    part = F.shiftright("_at", _ROW_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0]
    for i in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(i, 0))
    starts = F.array(*[F.lit(x).cast("long") for x in before])
    return ranged.withColumn(name, F.get(starts, part) + F.col("_at").bitwiseAND(F.lit(2**_ROW_BITS - 1))).drop("_at")
