"""N-gram Jaccard join by signature trees: documents whose sets of 5-word shingles are 80 % alike, as classes.

1. Documents with equal sets are one set from here on (`set_id`, 64 bits of its hash; the least doc_id stands for it).
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each, in any order that both use. The order
   here starts with a part of all shingles, those that fewest sets have first, so a set with enough shingles of its own selects nothing; a
   list of at most `OFTEN` shingles seen very often comes last (it only changes the order, so it may be incomplete). The sets
   that share such a shingle are tied to one of them (hot shingles in `SALTS` parts first), as many ties as sets. The
   connected components of these ties are clusters: no link leaves a cluster.
3. Whole sets of clusters are fetched once, and meet in cells of at most about `CELL_BYTES`. A small cluster is a cell. A
   large one is cut in blocks: first each block meets `LEADERS` sets of the cluster, which gives first components; then
   the blocks, dealt anew by component, meet pair by pair, but two blocks of one component do not.
4. In a cell, shingles of only one of its sets count for nothing, and sets that are left with too few go. The others are
   the leaves of a signature tree: a node holds the OR of its sets' token bitmaps (a bit of its own for each of the
   cell's `TOKENS` most shared shingles, hashed bits for the rest), the range of their sizes and the most collisions among their
   hashed bits. Two nodes are traversed together and dropped when the bits that they share plus the fewer collisions are
   less than the overlap their least sizes need, when their sizes are too far apart, or when they lie in one component;
   the bound never drops a linked pair. Pairs of leaves are verified on the spot by whole sets, and the cell gives only
   the links that join two components: fewer than it has sets, however alike they are.

Result: doc_id, n_shingles, component_id (the least doc_id reachable by links). The number of links of each document is
not counted: inside a group of g near copies that would take all g * g / 2 pairs.

Cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer than
five words has one; rows with a null id take part and link others, their component is the least id that is not null, or
null; repeated rows and repeated ids with other texts are each a row; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SIMILAR_PERCENT, WordHashes, id_and_text, read_table, shingle_set, shuffle_width, signed, slices, written

OFTEN = 200_000
OFTEN_IN_CHUNK = 8
CHUNK_SHINGLES = 2_000_000
SALTS = 64
#: Shingles below this hash, 7 of 20, are put in order by their counts.
SLICE = (7 * 2**20 // 20) << 44
#: What a cell holds at most, about: eight bytes a shingle and SET_BYTES a set.
CELL_BYTES = 16 << 20
SET_BYTES = 2048
LEADERS = 4
#: Pairs whose bitmaps are held side by side, under a kilobyte each.
PAIRS_AT_ONCE = 10_000
TOKENS = 4096
HASHED = 2048
#: Up to so many rows of two numbers are broadcast; more are joined by a shuffle.
FEW = 200_000
#: A set of more documents than this is a hot key; the hottest MOST_HOT are joined apart.
HOT_COPIES, MOST_HOT = 10_000, 1_000
FAN = 8
LEAF = 16


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR_PERCENT) -> np.ndarray:
    """The least intersection of sets of sizes a and b that are linked: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=3) - 2**63


# ---- passes over the texts ---------------------------------------------------------------------------

SETS = "doc_id long, text_key long, set_id long, n long, often array<long>"


def described(docs: DataFrame) -> DataFrame:
    """A row per document (a hash of its text, its set's id and size), and rows without these that list shingles seen often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        size = 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def table(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_key", "set_id", "n", "often"])

        def often() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()  # in place; np.unique with counts holds several copies
            end = max(0, len(values) - OFTEN_IN_CHUNK + 1)
            values = np.unique(values[:end][values[:end] == values[OFTEN_IN_CHUNK - 1 :]])
            return table([None], [None], [None], [None], [signed(values).tolist()])

        for batch in slices(batches):
            keys, sizes = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes)
                held.append(s)
                size += len(s)
                keys.append(set_id(s))
                sizes.append(len(s))
                if size >= CHUNK_SHINGLES:
                    yield often()
                    size = 0
            yield table(batch.column("doc_id"), batch.column("text_key"), keys, sizes, [None] * len(keys))
        if held:
            yield often()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SETS)


def prefix_candidates(shingles: np.ndarray, often: np.ndarray, percent: int = SIMILAR_PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that may be in a set's prefix, whether each is often seen, and the slack.

    The order of all shingles: those not in `often` and in the first SLICE of all hashes, by how many sets have them; then
    the others not in `often`, by hash; then `often`, by hash. The prefix is the first n - ceil(0.8 n) + 1 in this order, as many as two linked
    sets cannot both have without one in common. Counts are not known yet, so all of the first kind are given; the last
    `slack` of them are not in the prefix. Where it is negative, they all are, and so is what follows them.
    """
    n = len(shingles)
    count = n - -(-percent * n // 100) + 1
    hot = np.zeros(n, bool)
    if len(often):
        at = np.searchsorted(often, shingles)
        at[at == len(often)] = 0
        hot = often[at] == shingles
    early = ~hot & (shingles < SLICE)
    slack = int(early.sum()) - count
    if slack >= 0:
        return shingles[early], np.zeros(slack + count, bool), slack
    late, last = shingles[~hot & ~early][:-slack], shingles[hot]
    last = last[: max(0, -slack - len(late))]
    return np.concatenate([shingles[early], late, last]), np.arange(slack + count + len(late) + len(last)) >= slack + count + len(late), slack


PREFIX = "shingle long, salt int, n int, slack int, set_id long"
SHARED = "shingle long, salt int, n int, slack int, set_id long, n_sets long"
TIES = "a long, b long, shingle long"


def candidates(docs: DataFrame, often: list[int]) -> DataFrame:
    """What `prefix_candidates` gives for all sets; copies inside a task are left out. Only shingles seen often have salts."""
    frequent = np.sort(np.array(often, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        done: set[int] = set()
        for batch in slices(batches):
            parts, salts, keys, sizes, slacks = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes)
                key = set_id(s)
                if len(s) and key not in done:
                    done.add(key)
                    first, hot, slack = prefix_candidates(s, frequent)
                    parts.append(first)
                    salts.append(np.where(hot, key % SALTS + 1, 0).astype(np.int32))
                    keys.append(key)
                    sizes.append(len(s))
                    slacks.append(slack)
            if parts:
                many = [len(p) for p in parts]
                spread = lambda x, kind: np.repeat(np.array(x, kind), many)  # noqa: E731, B023
                columns = [signed(np.concatenate(parts)), np.concatenate(salts), spread(sizes, np.int32), spread(slacks, np.int32), spread(keys, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in PREFIX.split(", ")])

    return docs.select("text").mapInArrow(run, PREFIX)


def shared(rows: DataFrame) -> DataFrame:
    """The rows of shingles that two sets or more have, with their number; those with salts as they are."""
    names = [f.split()[0] for f in PREFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows of the last shingle: of those without salts, no more than `often` allows

        def table(shingle, salt, n, slack, key) -> pa.RecordBatch:
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
            shingle, salt, n, slack, key = (x[new] for x in (shingle, salt, n, slack, key))
            start = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])]))
            count = np.diff(np.append(start, len(shingle)))
            count = np.repeat(count, count)
            keep = (count > 1) | (salt > 0)
            columns = [x[keep] for x in (shingle, salt, n, slack, key)] + [np.where(salt > 0, 0, count)[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in SHARED.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                got = [np.concatenate([x, y]) for x, y in zip(held, got)]
            end = int(np.searchsorted(got[0], got[0][-1])) if got[1][-1] == 0 else len(got[0])
            held = [x[end:] for x in got]
            if end:
                yield table(*(x[:end] for x in got))
        if held is not None and len(held[0]):
            yield table(*held)

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "shingle", "salt").sortWithinPartitions("shingle", "salt", "set_id")
    return dealt.mapInArrow(run, SHARED)


def prefixes(rows: DataFrame) -> DataFrame:
    """shingle, salt, n, set_id: of the shared shingles, those in their set's prefix. A window holds one set's shingles."""
    own = Window.partitionBy("set_id", "early")
    place = F.row_number().over(own.orderBy("n_sets", "shingle"))
    early = (F.col("salt") == 0) & (F.shiftrightunsigned("shingle", 44) < (SLICE >> 44))
    ranked = rows.withColumn("early", early).withColumns({"place": place, "many": F.count("*").over(own)})
    return ranked.where(~F.col("early") | (F.col("place") <= F.col("many") - F.col("slack"))).select("shingle", "salt", "n", "set_id")


def ties(rows: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """a, b: sets that share a shingle of their prefixes, each tied to the first of those whose sizes lead up to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # shingle, salt, n of the row before, and the set that rows like it are tied to
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, salt, n, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "salt", "n", "set_id"))
            before = [np.concatenate([[x[0] if last is None else last[i]], x[:-1]]) for i, x in enumerate((shingle, salt, n))]
            new = (shingle != before[0]) | (salt != before[1])
            new |= (salt == 0) & (100 * before[2].astype(np.int64) < percent * n.astype(np.int64))
            if last is None:
                new[0] = True
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            centre = np.where(at >= 0, key[np.maximum(at, 0)], 0 if last is None else last[3])
            last = [shingle[-1], salt[-1], n[-1], centre[-1]]
            tied = (at < 0) | ~new
            tied &= centre != key
            hot = new & (salt > 0)
            a, b = np.concatenate([centre[tied], key[hot]]), np.concatenate([key[tied], key[hot]])
            of = pa.array(np.concatenate([np.zeros(int(tied.sum()), np.int64), shingle[hot]]), mask=np.arange(len(a)) < tied.sum())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), of], ["a", "b", "shingle"])

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "set_id")
    found = written(dealt.mapInArrow(run, TIES).distinct(), "ties")
    # the parts of a hot shingle, SALTS at most, are tied together
    parts = found.where("shingle IS NOT NULL").groupBy("shingle").agg(F.collect_set("a").alias("sets"))
    across = parts.select(F.array_min("sets").alias("a"), F.explode("sets").alias("b")).where("a != b").distinct()
    return found.where("shingle IS NULL").select("a", "b").unionByName(across)


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, n and data (the sorted shingles) of the wanted sets (text_key of one text that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        done: set[int] = set()
        for batch in slices(batches, 256):
            sets = []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                if key not in done:
                    done.add(key)
                    sets.append(shingle_set(text, hashes))
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "n", "data"])

    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("salt"))
    if wanted.count() <= FEW:
        found = keyed.join(F.broadcast(wanted), "text_key", "left_semi")
    else:
        found = keyed.join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))), ["text_key", "salt"], "left_semi")
    return found.select("text_key", "text").mapInArrow(run, "set_id long, n long, data binary").dropDuplicates(["set_id"])


# ---- the tree ----------------------------------------------------------------------------------------


class SignatureTree:
    """Levels of nodes over sets, leaves of LEAF sets first. A node: OR of bitmaps, size range, most collisions, component range."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, collisions: np.ndarray, component: np.ndarray) -> None:
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25)).astype(np.int64)
        self.order = np.lexsort((bits[:, 0], component, band))
        sizes, bits, collisions, component = sizes[self.order], bits[self.order], collisions[self.order], component[self.order]
        self.levels = [(bits, sizes, sizes, collisions, component, component)]
        while len(self.levels[-1][0]) > FAN:
            b, low, high, c, first, last = self.levels[-1]
            at = np.arange(0, len(b), LEAF if len(self.levels) == 1 else FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(c, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def possible_pairs(tree: SignatureTree, percent: int = SIMILAR_PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of the tree with itself: places (in its input) of all pairs of sets, each once, that the bound does
    not rule out and that do not lie in one component, in batches."""

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bits, low, high, most, first, last = tree.levels[level]
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        ok &= ~((first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j]))
        k = np.flatnonzero(ok)
        for s in range(0, len(k), PAIRS_AT_ONCE):
            part = k[s : s + PAIRS_AT_ONCE]
            x, y = i[part], j[part]
            shared = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(most[x], most[y])
            ok[part] = shared >= needed_overlap(low[x], low[y], percent)
        return ok

    top = len(tree.levels) - 1
    n = len(tree.levels[top][0])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        i, j = i[i <= j], j[i <= j]
        if level == 0:
            i, j = i[i < j], j[i < j]
        ok = possible(level, i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield tree.order[i], tree.order[j]
            continue
        fan, below = (LEAF if level == 1 else FAN), len(tree.levels[level - 1][0])
        wide, tall = np.minimum((i + 1) * fan, below) - i * fan, np.minimum((j + 1) * fan, below) - j * fan
        size = wide * tall
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // 200_000)) + 1):
            if len(part):
                t, s = tall[part], size[part]
                inner = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
                stack.append((level - 1, np.repeat(i[part] * fan, s) + inner // np.repeat(t, s), np.repeat(j[part] * fan, s) + inner % np.repeat(t, s)))


# ---- one cell ------------------------------------------------------------------------------------------


class Cell:
    """Sets that meet in one task: `links` are those that join their components to fewer."""

    def __init__(self, sets: list[np.ndarray], component: list[int], percent: int = SIMILAR_PERCENT) -> None:
        self.percent, self.count = percent, len(sets)
        self.label = np.unique(np.array(component, np.int64), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        if self.count == 2:
            if self.label[0] != self.label[1] and self._alike(len(sets[0]), len(sets[1]), len(np.intersect1d(sets[0], sets[1], assume_unique=True))):
                self.links.append((0, 1))
            return
        sizes = np.array([len(s) for s in sets], np.int64)
        owner, flat = np.repeat(np.arange(self.count), sizes), np.concatenate(sets)
        while True:  # shingles of one set only count for nothing; sets with too few others go, and so may others then
            _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
            shared = often[token] > 1
            flat, owner, token = flat[shared], owner[shared], token[shared]
            left = np.bincount(owner, minlength=self.count)
            stays = 100 * left >= percent * sizes
            gone = ~stays[owner]
            if not gone.any():
                break
            flat, owner = flat[~gone], owner[~gone]
        self.at = np.flatnonzero(stays & (left > 0))
        if len(self.at) < 2:
            return
        self.sizes = sizes[self.at]
        owner = (np.cumsum(stays & (left > 0)) - 1)[owner]
        self._signatures(owner, token, often)
        self._leaders()
        tree = SignatureTree(self.sizes, np.concatenate([self.exact, self.hashed], 1), self.collisions, self.label[self.at])
        for i, j in possible_pairs(tree, percent):
            for s in range(0, len(i), PAIRS_AT_ONCE):  # what is linked by then is not compared again
                self._verify(i[s : s + PAIRS_AT_ONCE], j[s : s + PAIRS_AT_ONCE])

    def _alike(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def _signatures(self, owner: np.ndarray, token: np.ndarray, often: np.ndarray) -> None:
        """Bits of the sets that stay: the most shared tokens have their own, the rest hashed ones; and the rest as lists."""
        n = len(self.at)
        here = np.unique(token)
        ranked = here[np.argsort(-often[here], kind="stable")]
        place = np.full(len(often), -1, np.int64)
        place[ranked] = np.arange(len(ranked))
        place = place[token]
        width = min(TOKENS, -(-len(ranked) // 64) * 64)
        own = place < TOKENS
        self.exact = self._bitmap(n, width, owner[own], place[own])
        rest, of = place[~own], owner[~own]
        self.rest = np.bincount(of, minlength=n)
        self.hashed = self._bitmap(n, HASHED if len(rest) else 64, of, (rest * 2654435761 >> 7) % HASHED)
        self.collisions = self.rest - np.bitwise_count(self.hashed).sum(1, dtype=np.int64)
        order = np.lexsort((rest, of))
        self.lists = np.split(rest[order], np.cumsum(self.rest)[:-1])

    @staticmethod
    def _bitmap(rows: int, width: int, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, width // 64), np.uint64)
        for s in range(0, rows, 1024):
            mine = (row >= s) & (row < s + 1024)
            dense = np.zeros((min(1024, rows - s), width), bool)
            dense[row[mine] - s, bit[mine]] = True
            out[s : s + 1024] = np.packbits(dense, axis=1).view(np.uint64)
        return out

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links among pairs of places in self.at that lie in different components."""
        apart = self.label[self.at[i]] != self.label[self.at[j]]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        shared = np.bitwise_count(self.exact[i] & self.exact[j]).sum(1, dtype=np.int64)
        need = needed_overlap(self.sizes[i], self.sizes[j], self.percent)
        near = shared + np.minimum(self.rest[i], self.rest[j]) >= need
        for a, b, have, least in zip(i[near].tolist(), j[near].tolist(), shared[near].tolist(), need[near].tolist()):
            x, y = self.at[a], self.at[b]
            if self.label[x] == self.label[y]:
                continue
            if have < least:
                have += len(np.intersect1d(self.lists[a], self.lists[b], assume_unique=True))
            if have >= least:
                self.links.append((int(x), int(y)))
                self.label[self.label == self.label[y]] = self.label[x]

    def _leaders(self, most: int = 16) -> None:
        """A few sets are compared with all others first: where most are alike, the traversal then finds one component."""
        everyone = np.arange(len(self.at))
        tried = np.zeros(len(self.at), bool)
        for _ in range(min(most, len(self.at) // LEAF)):
            label, counts = np.unique(self.label[self.at], return_counts=True)
            alone = ~tried & (counts[np.searchsorted(label, self.label[self.at])] == 1)
            if not alone.any():
                return
            leader = int(np.flatnonzero(alone)[0])
            tried[leader] = True
            others = everyone[everyone != leader]
            self._verify(np.full(len(others), leader), others)


LINKS = "a long, b long"


def cell_links(cells: DataFrame) -> DataFrame:
    """a, b: links that join the components of each cell. cells: cell, part, set_id, component, data; a set may come twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "set_id", "component", "data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, found in groupby(rows(batches), key=lambda r: r[:2]):
            sets = {key: (component, np.frombuffer(data, np.uint64)) for _, _, key, component, data in found}
            if len(sets) > 1:
                keys = list(sets)
                out += [(keys[i], keys[j]) for i, j in Cell([x[1] for x in sets.values()], [x[0] for x in sets.values()]).links]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    dealt = cells.select("cell", "part", "set_id", "component", "data").repartition(shuffle_width(cells.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "set_id")
    return dealt.mapInArrow(run, LINKS)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of all nodes of the links, by rounds of least labels and jumps."""
    links = links.where("a != b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        new = written(step.join(jump, "to").select("node", F.least("to", "jump").alias("component"), "was"), "labels")
        labels = new.select("node", "component")
        if new.where("component != was").isEmpty():
            return labels


# ---- operator --------------------------------------------------------------------------------------------


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it is proven small."""
    return F.broadcast(df) if df.count() <= FEW else df


def first_cells(sets: DataFrame, large: DataFrame) -> DataFrame:
    """Small clusters whole; blocks of large ones (cluster, blocks, leaders), each with the cluster's leaders."""
    alone = F.col("set_id").alias("component")
    near = sets.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    plain = near.select(F.col("cluster").alias("cell"), F.pmod(F.xxhash64("set_id"), "blocks").alias("part"), "set_id", alone, "data")
    leading = near.where("blocks > 1").where(F.array_contains("leaders", F.col("set_id")))
    return plain.unionByName(leading.select(F.col("cluster").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), "set_id", alone, "data"))


def further_cells(sets: DataFrame, cell_bytes: int) -> DataFrame:
    """Pairs of blocks of large clusters; sets have a component. A large component has blocks of its own, the others share some."""
    half = cell_bytes // 2
    weight = F.sum(F.col("n") * 8 + SET_BYTES).alias("weight")
    sizes = sets.groupBy("cluster", "component").agg(weight)
    apart = sizes.where(F.col("weight") > half).select("cluster", "component", F.ceil(F.col("weight") / half).alias("own_blocks"))
    others = sizes.where(F.col("weight") <= half).groupBy("cluster").agg(F.ceil(F.sum("weight") / half).alias("shared_blocks"))
    where = sets.join(_few(apart), ["cluster", "component"], "left").join(_few(others), "cluster", "left")
    own = F.col("own_blocks").isNotNull()
    block = F.when(own, F.xxhash64("component", F.pmod(F.xxhash64("set_id"), "own_blocks"))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("component"), "shared_blocks")))
    where = written(where.select("cluster", block.alias("block"), F.when(own, F.col("component")).alias("whole"), "set_id", "component", "data"), "blocks")
    blocks = where.select("cluster", "block", "whole").distinct()
    second = blocks.select("cluster", F.col("block").alias("block2"), F.col("whole").alias("whole2"))
    pairs = blocks.join(second, "cluster").where("block <= block2 AND NOT coalesce(whole = whole2, false)")
    meet = pairs.select("cluster", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"), F.xxhash64("cluster", "block", "block2").alias("part"))
    return where.join(meet, ["cluster", "block"]).select(F.col("cluster").alias("cell"), "part", "set_id", "component", "data")


def set_links(docs: DataFrame, sets: DataFrame, often: list[int], cell_bytes: int = CELL_BYTES) -> DataFrame | None:
    """Links (a, b) between sets, enough to connect all that any links connect. sets: set_id, text_key, n."""
    found = ties(prefixes(shared(candidates(docs, often))))
    if found.isEmpty():
        return None
    clusters = components(found).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    nodes = written(sets.join(clusters, "set_id"), "nodes")
    ranked = [F.min(F.struct(F.xxhash64("set_id", F.lit(k)).alias("rank"), "set_id")).alias(f"leader{k}") for k in range(LEADERS)]
    sizes = nodes.groupBy("cluster").agg(F.sum(F.col("n") * 8 + SET_BYTES).alias("weight"), *ranked).where(F.col("weight") > cell_bytes)
    large = written(sizes.select("cluster", F.ceil(F.col("weight") / cell_bytes).alias("blocks"), F.array(*[F.col(f"leader{k}.set_id") for k in range(LEADERS)]).alias("leaders")), "large")
    whole = whole_sets(docs, nodes.select("text_key"))
    whole = written(whole.join(_few(nodes.select("set_id", "cluster")), "set_id"), "whole")
    links = written(cell_links(first_cells(whole, _few(large))), "links")
    if large.isEmpty():
        return links
    labels = components(links).select(F.col("node").alias("set_id"), "component")
    again = whole.join(_few(large.select("cluster")), "cluster", "left_semi").join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return links.unionByName(written(cell_links(further_cells(again, cell_bytes)), "links"))


def jaccard_classes(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = id_and_text(docs)
    everything = written(described(docs), "sets")
    own = everything.where("set_id IS NOT NULL").select("doc_id", "set_id", "n")
    often = [r.t for r in everything.where("often IS NOT NULL").select(F.explode("often").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(OFTEN).collect()]
    sets = written(everything.where("n > 0").groupBy("set_id").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "distinct")
    links = set_links(docs, sets.select("set_id", "text_key", "n"), often, cell_bytes)
    classes = sets.select("set_id", "class_id", "copies")
    if links is not None:
        labels = components(links).withColumnRenamed("node", "set_id")
        named = written(classes.join(labels, "set_id"), "linked")
        least = named.groupBy("component").agg(F.min("class_id").alias("least"))
        linked = named.join(least, "component").select("set_id", F.col("least").alias("linked_id"))
        classes = classes.join(linked, "set_id", "left").select("set_id", F.coalesce("linked_id", "class_id").alias("class_id"), "copies")
    classes = written(classes, "classes")
    # sets of very many documents, MOST_HOT rows at most, are broadcast, so that their rows stay where they are
    hot = classes.where(F.col("copies") > HOT_COPIES).orderBy(F.desc("copies"), "set_id").limit(MOST_HOT).select("set_id", F.struct("class_id").alias("hot"))
    rows = own.join(F.broadcast(hot), "set_id", "left")
    told = rows.where("hot IS NOT NULL").select("doc_id", "n", F.col("hot.class_id").alias("class_id"))
    told = told.unionByName(rows.where("hot IS NULL").join(classes.select("set_id", "class_id"), "set_id", "left").select("doc_id", "n", "class_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, without those that are not the first of their class (by id).

    Rows with a null id stay, and of rows with one id all stay or none.
    """
    drop = jaccard_classes(docs).where("doc_id IS NOT NULL AND component_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col("_dropped"), "left_anti")


def op3_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under the n-gram Jaccard join."""
    return jaccard_classes(read_table(spark, sf_dir, "documents"))
