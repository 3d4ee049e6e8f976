"""Merkle manifest of a dataset: a root over all rows, a proof for each row, and what a changed row folds to.

Every row is a leaf, the sha256 of its fields. Leaves of one group (source) ascend by key; every `FAN` consecutive nodes
are hashed together until one is left, the group's subroot; the subroots in the groups' order are treated likewise and
give the root.

Parents are stored as preimages: the hashes of a parent's children, concatenated. A leaf joins the preimages of its
ancestors; in each it finds its own 64 characters by its place, the rest are its siblings (the proof), and with another
hash in its place the parent's own hash is computed anew (folding).

Trees are built block by block: `FAN ** LEVELS` consecutive nodes of a group meet in one task, which hashes up to `LEVELS`
levels at once, so a group of any size is spread over many tasks and the number of rounds grows with the logarithm of the
largest group. Leaves are numbered by ranges of (group, key), never by a window over a group. Only a leaf's hash, not
its text, is shuffled, and what a leaf needs of higher rounds joins its whole block, as one row.

Cases: a null group is a group of its own, the first; a null key is the least and is not tampered with; rows that repeat a
key are ordered by their leaf (equal leaves are interchangeable); every row has one result; an empty table gives an empty
one; a group of one leaf has it as its subroot, and a proof without siblings is the hash of the empty string; further
columns are not read. Numbers of other types than long are taken as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import numbered, read_table, written

FAN = 3
#: Levels that one task hashes at once: FAN ** LEVELS nodes of a group are one block.
LEVELS = 5
BLOCK = FAN**LEVELS
_HEX = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hash_of(joined: str) -> str:
    return sha256(joined.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[name].cast("string")) for name in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """group, key, leaf and changed: the leaf of the row as it was tampered with, null where it was not.

    Tampering takes the line feeds out of the text where 2 divides the crc32 of the decimal key.
    """
    values = {name: F.col(name).cast("long") if name in ("doc_id", "n_chars") else F.col(name).cast("string") for name in FIELDS}
    tampered = leaf_of(values | {"text": F.replace(values["text"], F.lit("\n"), F.lit(""))})
    chosen = F.crc32(values["doc_id"].cast("string")) % 2 == 0
    return docs.select(values["source"].alias("group"), values["doc_id"].alias("key"), leaf_of(values).alias("leaf"), F.when(chosen, tampered).alias("changed"))


# ---- trees ---------------------------------------------------------------------------------------


def block_preimages(hashes: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """The preimages of a block's parents, level by level, and the last hash.

    `levels` None hashes until one node is left, as in a group that is one block; otherwise so many levels, though one
    node is left before, as in a block that has neighbours.
    """
    found: list[list[str]] = []
    while len(hashes) > 1 if levels is None else len(found) < levels:
        found.append(["".join(hashes[i : i + FAN]) for i in range(0, len(hashes), FAN)])
        hashes = [hash_of(x) for x in found[-1]]
    return found, hashes[0]


_NODES = "items array<struct<key:long,leaf:string,changed:string>>"
_BLOCKS = f"group string, block long, blocks long, preimages array<array<string>>, top string, {_NODES}"


def blocks_of(nodes: DataFrame) -> DataFrame:
    """One row for each block: its nodes in order, the preimages of its parents and its top hash.

    nodes: group, place (in the group), size (of the group), key, leaf, changed.
    """
    items = F.sort_array(F.collect_list(F.struct("place", "key", "leaf", "changed")))
    gathered = nodes.groupBy("group", F.floor(F.col("place") / BLOCK).alias("block"), F.ceil(F.col("size") / BLOCK).alias("blocks")).agg(items.alias("items"))
    gathered = gathered.select("group", "block", "blocks", F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["leaf"].alias("leaf"), x["changed"].alias("changed"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preimages, tops = [], []
            for leaf_rows, blocks in zip(batch.column("items"), batch.column("blocks").to_pylist()):
                levels, top = block_preimages(leaf_rows.values.field("leaf").to_pylist(), None if blocks == 1 else LEVELS)
                preimages.append(levels)
                tops.append(top)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("group", "block", "blocks")), pa.array(preimages, pa.list_(pa.list_(pa.string()))), pa.array(tops, pa.string()), batch.column("items")],
                ["group", "block", "blocks", "preimages", "top", "items"],
            )

    return gathered.mapInArrow(run, _BLOCKS)


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks of every round; the last round has one block for each group, whose top is the subroot."""
    rounds = [written(blocks_of(nodes), "merkle-0")]
    while rounds[-1].where("blocks > 1").limit(1).count():
        tops = rounds[-1].where("blocks > 1").select("group", F.col("block").alias("place"), F.col("blocks").alias("size"), F.lit(None).cast("long").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("changed"))
        rounds.append(written(blocks_of(tops), f"merkle-{len(rounds)}"))
    return rounds


def subroots(rounds: list[DataFrame]) -> DataFrame:
    found = [r.where("blocks = 1").select("group", F.col("top").alias("subroot")) for r in rounds]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


_PATH = "struct<own:array<int>,preimages:array<string>>"


def own_path(preimages: list[list[str]], place: int) -> tuple[list[int], list[str]]:
    """The preimages above the node at this place of a block, and its slot in each."""
    slots, path = [], []
    for level in preimages:
        slots.append(place % FAN)
        place //= FAN
        path.append(level[place])
    return slots, path


def block_paths(rounds: list[DataFrame]) -> DataFrame:
    """group, block and above: for every block of round 0, the slots and preimages above its top, up to its subroot.

    From the last round down: a block's own path inside the block that holds it, then that block's.
    """
    none = F.struct(F.array().cast("array<int>").alias("own"), F.array().cast("array<string>").alias("preimages"))
    top_down = None
    for held in reversed(rounds[1:]):
        known = held.where("blocks = 1").select("group", "block", "preimages", F.size("items").alias("n"), none.alias("above"))
        if top_down is not None:
            more = held.where("blocks > 1").select("group", "block", "preimages", F.size("items").alias("n"))
            known = known.unionByName(joined(more, top_down).select("group", "block", "preimages", "n", "above"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    paths = [own_path(row["preimages"], i) for i in range(row["n"])]
                    above = [{"own": s + row["above"]["own"], "preimages": p + row["above"]["preimages"]} for s, p in paths]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["group"]] * row["n"], pa.string()), pa.array([row["block"] * BLOCK + i for i in range(row["n"])], pa.int64()), pa.array(above, pa.struct([("own", pa.list_(pa.int32())), ("preimages", pa.list_(pa.string()))]))],
                        ["group", "block", "above"],
                    )

        top_down = known.mapInArrow(run, f"group string, block long, above {_PATH}")
        top_down = written(top_down, "merkle-paths")
    first = rounds[0].where("blocks = 1").select("group", "block", none.alias("above"))
    return first if top_down is None else first.unionByName(joined(rounds[0].where("blocks > 1").select("group", "block"), top_down))


def joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The blocks with their paths; a null group meets itself."""
    b, p = blocks.alias("b"), paths.alias("p")
    return b.join(p, F.col("b.group").eqNullSafe(F.col("p.group")) & (F.col("b.block") == F.col("p.block"))).select("b.*", "p.above")


def fold(leaf: str, slots: list[int], path: list[str]) -> str:
    """The root that a leaf gives when its hash, and each parent's new one, is spliced into its slot."""
    for slot, preimage in zip(slots, path):
        at = slot * _HEX
        leaf = hash_of(preimage[:at] + leaf + preimage[at + _HEX :])
    return leaf


def siblings(slots: list[int], path: list[str]) -> str:
    """All siblings, level by level, left to right: each preimage without the own slot."""
    return "".join(preimage[: slot * _HEX] + preimage[(slot + 1) * _HEX :] for slot, preimage in zip(slots, path))


# ---- the manifest --------------------------------------------------------------------------------

_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def in_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (group, key, leaf, changed) with place and size in their group; and the groups: group, start, size."""
    placed = numbered(rows, "group", "key", "leaf", "changed", name="at")
    groups = written(placed.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("size")), "merkle-groups")
    r, g = placed.alias("r"), groups.alias("g")
    joint = r.join(g, F.col("r.group").eqNullSafe(F.col("g.group")))
    return joint.select("r.group", (F.col("at") - F.col("start")).alias("place"), "g.size", "key", "leaf", "changed"), groups


def manifest(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The rounds of the groups' trees, those of the tree over the subroots, and the groups' table: group, rank, subroot.

    In the upper tree a group is the key of its subroot by its rank in the groups' order.
    """
    nodes, groups = in_groups(rows)
    rounds = forest(nodes)
    s, g = subroots(rounds).alias("s"), numbered(groups, "start", name="rank").alias("g")
    ranked = written(g.join(s, F.col("s.group").eqNullSafe(F.col("g.group"))).select("g.group", "g.rank", "s.subroot"), "merkle-subroots")
    upper = ranked.select(F.lit("").alias("group"), F.col("rank").alias("place"), F.lit(ranked.count()).alias("size"), F.col("rank").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("changed"))
    return rounds, forest(upper), ranked


def proofs(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf."""
    rounds, upper, ranked = manifest(rows)
    root = upper[-1].where("blocks = 1").select("top").first()
    root = root["top"] if root else ""
    # ranks of subroots with their paths to the root; few a block, joined by rank
    over = upper[0].withColumnRenamed("preimages", "inner").join(block_paths(upper).select("block", "above"), "block")
    over = over.select(F.posexplode(F.col("items.key")).alias("slot", "rank"), "inner", "above").alias("o").join(ranked.alias("k"), F.col("o.rank") == F.col("k.rank")).select("k.group", "k.subroot", "slot", "inner", "above")

    def group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, path = own_path(row["inner"], row["slot"])
                over_all = {"own": own + row["above"]["own"], "preimages": path + row["above"]["preimages"]}
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]], pa.string()), pa.array([row["subroot"]], pa.string()), pa.array([over_all], pa.struct([("own", pa.list_(pa.int32())), ("preimages", pa.list_(pa.string()))]))], ["group", "subroot", "to_root"])

    to_root = written(over.mapInArrow(group_paths, f"group string, subroot string, to_root {_PATH}"), "merkle-to-root")
    b = joined(rounds[0].select("group", "block", "preimages", "items"), block_paths(rounds)).alias("b")
    whole = b.join(to_root.alias("t"), F.col("b.group").eqNullSafe(F.col("t.group"))).select("preimages", "items", "above", "subroot", "to_root")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                slots = row["above"]["own"] + row["to_root"]["own"]
                path = row["above"]["preimages"] + row["to_root"]["preimages"]
                beyond, columns = siblings(slots, path), [[] for _ in range(7)]
                for place, item in enumerate(row["items"]):
                    own, inner = own_path(row["preimages"], place)
                    changed = item["changed"] if item["changed"] is not None else item["leaf"]
                    folded = fold(changed, own + slots, inner + path)
                    proof = hash_of(siblings(own, inner) + beyond)
                    for column, value in zip(columns, (item["key"], item["leaf"], row["subroot"], root, proof, folded, folded == root)):
                        column.append(value)
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _PROVED.split(", ")])

    return whole.mapInArrow(prove, _PROVED)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every document."""
    return proofs(written(leaves(read_table(spark, sf_dir, "documents")), "merkle-leaves"))
