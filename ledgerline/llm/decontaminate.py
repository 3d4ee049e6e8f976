"""Benchmark decontamination: pairs of near words join passages to test items, Smith-Waterman scores the pairs.

A seed is a pair of an item's words that are neighbours or have one word between them; it is hit where a text has the two
words likewise. Between two matched words that follow each other in an alignment, a score of 2 a match is left whole
(neighbours in both), loses 1 (one word between them on either side or both) or loses 2 or more. An alignment of score S
thus has seeds worth S - 2 at least, of which each place of the item gives 2 or 1. The seeds of the words most common in
the corpus are left out as far as they are worth less than that together; so an alignment of `LEAST` always hits one of
the others, however the copy was edited and however large the corpus is. Corpus counts only say which seeds are cheap.
Where a document hits a seed of an item, the seeds of all kinds around it are counted, and unless they are worth too
little, a local alignment of the item's words to the words there scores the copy: score = alignment score over the score
of an exact copy. Pairs that score `LEAST` or more are reported. Of an item below `SHORT` words that is not enough, as a few
common words in a row score as much by chance: four of its words (all, if it has fewer) must match, and they must carry
`TELLING` of its information, the sum of its words' -log2(rate in the corpus). Rates are shares, so the rule does not depend
on how large the corpus is.

Items go to the tasks in blocks of at most `BLOCK_BYTES` of text, one pass over the documents for each block, so what is
sent does not grow with the benchmark. Nothing of the documents reaches the driver but the counts of the items' words.

Cases: null and empty texts, and items of one word, pair with nothing; null ids are carried along; repeated rows are all
reported; equal items are reported each; an empty table on either side gives an empty result (or leaves the documents
as they are); further columns are not read, and kept by `drop_contaminated`.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.align import MATCH, Alignment, disjoint_alignments, most_shared, plain_words
from ledgerline.llm.common import id_and_text, read_table, slices

LEAST = 0.4
BLOCK_BYTES = 4_000_000
#: Items of fewer words need so many matched words, which hold so much of the item's information.
SHORT, SHORT_MATCHED, TELLING = 12, 4, 0.6

_STEP = np.uint64(0x9E3779B97F4A7C15)


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[list[tuple[int | None, list[bytes]]]]:
    """(item id, words) of all items, in blocks of at most about `limit` bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-2 * size // limit) if size > limit else 1)
    blocks = []
    for i in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).collect()
        blocks.append(sorted(((r.item_id, plain_words(r.text)) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
    return blocks


def word_counts(docs: DataFrame, wanted: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How often the wanted words stand in all texts, and how many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                words = plain_words(text)
                total += len(words)
                counts.update(filter(wanted.__contains__, words))
        keys = [b"", *counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([total, *counts.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts, counts.pop(b"", 0)


class Seeds:
    """The seeds of one block of items, and their lookup in a text's words."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], counts: dict[bytes, int], total: int, least: float = LEAST) -> None:
        self.items, self.least = items, least
        words = sorted({w for _, ws in items for w in ws})
        self.vocabulary = {w: i + 1 for i, w in enumerate(words)}
        rate = np.array([1.0] + [max(1, counts.get(w, 0)) / max(1, total) for w in words])
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        self.bits = -np.log2(np.minimum(rate, 0.999))
        found: list[tuple[int, int, int]] = []  # pair of words, item, place
        for k, ids in enumerate(self.ids):
            seeds = sorted((-rate[ids[i]] * rate[ids[i + d]], i, d) for d in (1, 2) for i in range(len(ids) - d))
            left_out, lost = set(), np.zeros(len(ids), np.int64)
            for _, i, d in seeds:  # the most common first
                more = max(0, 3 - d - lost[i])
                if lost.sum() + more >= self.worth(len(ids)):
                    break
                lost[i] += more
                left_out.add((i, d))
            found += [(self._pair(ids[i], ids[i + d]), k, i) for _, i, d in seeds if (i, d) not in left_out]
        rows = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
        self.pairs, self.first = np.unique(rows[:, 0], return_index=True)
        self.first = np.append(self.first, len(rows))
        self.item, self.place = rows[:, 1], rows[:, 2]
        self.table = np.zeros(1 << 16, bool)
        self.table[self._slot(self.pairs)] = True

    def worth(self, words: int) -> float:
        """The least worth of an alignment's seeds that scores enough."""
        return 2 * self.least * words - 2 - 1e-9

    def _pair(self, a, b):
        return a * (len(self.vocabulary) + 1) + b

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _STEP) >> np.uint64(48)).astype(np.int64)

    def hits(self, ids: np.ndarray) -> dict[int, list[int]]:
        """item -> where it would start in the text, of every seed in the text."""
        at, which = [], []
        for d in (1, 2):
            i = np.flatnonzero((ids[:-d] > 0) & (ids[d:] > 0))
            pairs = self._pair(ids[i], ids[i + d])
            some = self.table[self._slot(pairs)]
            i, pairs = i[some], pairs[some]
            k = np.searchsorted(self.pairs, pairs)
            k[k == len(self.pairs)] = 0
            same = self.pairs[k] == pairs if len(self.pairs) else np.zeros(len(k), bool)
            at.append(i[same])
            which.append(k[same])
        at, which = np.concatenate(at), np.concatenate(which)
        found: dict[int, list[int]] = defaultdict(list)
        if not len(at):
            return found
        n = self.first[which + 1] - self.first[which]
        row = np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        for item, start in zip(self.item[row].tolist(), (np.repeat(at, n) - self.place[row]).tolist()):
            found[item].append(start)
        return found

    def _possible(self, query: np.ndarray) -> Callable[[np.ndarray], bool]:
        """Whether the seeds of all kinds in a part of a text are worth enough for the item."""
        bound = most_shared(query)
        near, wide = self._pair(query[:-1], query[1:]), self._pair(query[:-2], query[2:])

        def possible(part: np.ndarray) -> bool:
            if len(part) < 2 or bound(part) < max(2, self.least * len(query)):
                return False
            one, two = self._pair(part[:-1], part[1:]), self._pair(part[:-2], part[2:])
            both = np.concatenate([one, two])
            worth = np.isin(near, both).astype(np.int64)
            worth[: len(wide)] |= np.isin(wide, both)
            worth[np.isin(near, one)] = 2
            return worth.sum() > 0 and worth.sum() >= self.worth(len(query))

        return possible

    def tells(self, item: int, x: Alignment) -> bool:
        """Whether an alignment that scores enough is a copy: always for long items, for short ones by the matched words."""
        query = self.ids[item]
        if len(query) >= SHORT:
            return True
        bits = self.bits[query]
        return x.matched >= min(len(query), SHORT_MATCHED) and bits[list(x.at)].sum() >= TELLING * bits.sum()

    def copies(self, text: str) -> list[tuple]:
        """The alignments that tell."""
        return self.alignments(text, self.tells)

    def alignments(self, text: str, tells: Callable[[int, Alignment], bool] = lambda item, x: True) -> list[tuple]:
        """(item id, score, matched words, first and end word in the text, first and end word in the item)."""
        words = plain_words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        out = []
        for item, starts in self.hits(ids).items():
            query = self.ids[item]
            reach = max(8, math.ceil(2 * (1 - self.least) * len(query)))  # an alignment with more gaps scores too little
            ranges: list[list[int]] = []
            for start in sorted(starts):
                low, high = max(0, start - reach), min(len(ids), start + len(query) + reach)
                if ranges and low <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], high)
                else:
                    ranges.append([low, high])
            possible, full = self._possible(query), MATCH * len(query)
            for low, high in ranges:
                for x in disjoint_alignments(query, ids[low:high], len(query) + 2 * reach, possible, lambda x: x.matched > 1 and x.score >= self.least * full and tells(item, x)):  # noqa: B023
                    out.append((self.items[item][0], x.score / full, x.matched, low + x.b_start, low + x.b_end, x.a_start, x.a_end))
        return out


FOUND = "doc_id long, item_id long, score double, matched long, start_word long, end_word long, item_start long, item_end long"


def _all_seeds(docs: DataFrame, benchmark: DataFrame, least: float) -> list[Seeds]:
    blocks = [b for b in item_blocks(benchmark) if b]
    out = []
    for block in blocks:
        counts, total = word_counts(docs, {w for _, ws in block for w in ws})
        out.append(Seeds(block, counts, total, least))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document and copy of an item in it."""
    rows = id_and_text(docs)
    out = docs.sparkSession.createDataFrame([], FOUND)
    for k, seeds in enumerate(_all_seeds(rows, benchmark, least)):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in seeds.copies(text)]
                cols = list(zip(*found)) if found else [[] for _ in range(8)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in FOUND.split(", ")])

        made = rows.mapInArrow(run, FOUND)
        out = made if k == 0 else out.unionByName(made)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns as they are, that hold no copy of an item."""
    at = docs.columns.index("text")
    for seeds in _all_seeds(id_and_text(docs), benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([not seeds.copies(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a benchmark item in a document, with its score and place."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
