"""Token ids in files of Simple-8b words.

A word is 64 bits: a selector in the top four, ids in the other sixty. `SELECTORS` gives how many ids a selector packs
and of how many bits. Selector 15 is an escape: the word after it is one id of 64 bits. Words are grouped in blocks of
`BLOCK` ids; a block starts on a word of its own and a file lists the words before each, so that all blocks are packed
and unpacked side by side in numpy, and a reader may start at any block.

A file: the magic, then little-endian u64 counts (documents, ids, blocks, words), the document ids (i64), whether each
is null (u8), the ids per document (u64), the word offset of each block (u64), the words (u64). Files are named by
range and sequence, so that the order of their names is ascending doc_id order. A task that runs again writes the same
bytes under the same name.

Cases: a null or empty text has only the end id; null ids come first; repeated ids keep all their rows, next to each
other; an empty table gives no files and an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.common import id_and_text, new_path, shuffle_width, slices, with_ordered_part, written

#: (ids in a word, bits of each) by selector.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
BLOCK = 1024
MAGIC = b"S8BW0001"
FILE_IDS = 4_000_000


_WIDTHS = np.array([max(1, int(x).bit_length()) for x in range(65_536)], np.uint8)
#: For each count of ids, two smaller counts' starts whose runs cover it: (count, run, shift).
_COVERS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 15, 5), (30, 15, 15), (60, 30, 30)]


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    if values.dtype == np.uint16:
        return _WIDTHS[values]
    values = values.astype(np.uint64)
    out = np.zeros(len(values), np.uint8)
    for part in range(4):
        low = (values >> np.uint64(16 * part)).astype(np.uint16)
        np.copyto(out, _WIDTHS[low] + np.uint8(16 * part), where=low > 0)
    return np.maximum(out, 1)


def pack(ids: np.ndarray, block: int = BLOCK, blocks: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The words of the ids, and the words before each block. So many blocks are packed side by side."""
    words, offsets, before = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    for at in range(0, len(ids), block * blocks):
        some, places = _pack(ids[at : at + block * blocks], block)
        words.append(some)
        offsets.append(places + np.uint64(before))
        before += len(some)
    return np.concatenate(words), np.concatenate(offsets)


def _pack(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    widest = {1: np.concatenate([_width(ids), np.zeros(60, np.uint8)])}  # the most bits of any id in the run that starts at each place
    for count, run, shift in _COVERS:
        most = widest[run].copy()
        np.maximum(most[:-shift], widest[run][shift:], out=most[:-shift])
        widest[count] = most
    best = np.full(n, ESCAPE, np.int8)  # the selector of a word that starts at each id: the first that fits
    room = np.minimum(block - np.arange(n, dtype=np.int32) % block, n - np.arange(n, dtype=np.int64)).astype(np.int16 if block < 2**15 else np.int64)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[selector]
        best[(widest[count][:n] <= bits) & (room >= count)] = selector
    del widest
    ids = ids.astype(np.uint64)
    step = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)[best]
    n_blocks = -(-n // block)
    at = np.arange(n_blocks) * block
    ends = np.minimum(at + block, n)
    live = np.arange(n_blocks)
    used = np.zeros(n, bool)  # where words start
    while len(live):  # one word of every block that has ids left
        here = at[live]
        used[here] = True
        here += step[here]
        at[live] = here
        live = live[here < ends[live]]
    starts = np.flatnonzero(used)
    chosen = best[starts].astype(np.int64)
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            word = np.full(len(mine), selector << 60, np.uint64)
            for i in range(count):
                word |= ids[starts[mine] + i] << np.uint64(i * bits)
            words[place[mine]] = word
    mine = np.flatnonzero(chosen == ESCAPE)
    if len(mine):
        words[place[mine]] = np.uint64(ESCAPE << 60)
        words[place[mine] + 1] = ids[starts[mine]]
    first = np.searchsorted(starts, np.arange(n_blocks) * block)
    return words, place[first].astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of pack's words. Blocks say where words start; no word is decoded before its place is known."""
    out = np.empty(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a literal's top bits may look like any selector, so walk from each block's start
        at = offsets.astype(np.int64).copy()
        ends = np.append(offsets[1:], len(words)).astype(np.int64)
        live = np.flatnonzero(at < ends)
        while len(live):
            escaped = selector[at[live]] == ESCAPE
            literal[at[live][escaped] + 1] = True
            at[live] += 1 + escaped
            live = live[at[live] < ends[live]]
    count = np.array([c for c, _ in SELECTORS] + [0, 0], np.int64)[selector]
    count[literal] = 1
    place = np.cumsum(count) - count
    for s, (many, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero((selector == s) & ~literal)
        for i in range(many) if len(mine) else ():
            out[place[mine] + i] = (words[mine] >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    out[place[literal]] = words[literal]
    return out


def to_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(words)], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    return MAGIC + head + keys + np.array(counts, "<u8").tobytes() + offsets.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, ids per document, all ids."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of packed ids")
    docs, n, blocks, n_words = (int(x) for x in np.frombuffer(data, "<u8", 4, len(MAGIC)))
    at = len(MAGIC) + 32
    keys = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, "u1", docs, at + 8 * docs)
    at += 9 * docs
    counts = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks, at + 8 * docs)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (docs + blocks))
    return [None if z else int(k) for k, z in zip(keys, null)], counts, unpack(words, offsets, n)


# ---- the tokenizer ---------------------------------------------------------------------------------

#: Whitespace other than a plain space or line feed, neighbours of whitespace, and the mark of first pieces. Texts with
#: any of these go to the library whole.
_ODD = ["  ", "\n ", " \n", "\n\n", "\t", "\r", "\v", "\f", "\0", "\x1c", "\x1d", "\x1e", "\x1f"]
_ODD_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_RUN_OF_MARKS = re.compile(r"[.,](?<=[\W_][.,])(?:[ \n]|\Z)")


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    Byte-level pre-tokenization starts a new match at every space that follows a non-space, before and after a lone line
    feed between non-spaces, and where a letter or digit is followed by one full stop or comma and then a space or line
    feed. So the pieces between such places encode alone as they do inside the text. A new piece of a space and letters is
    one match by the library's own pre-tokenizer (`spelled`), so its model alone encodes it. Other new pieces that start
    with a space go to the library as one text: only the first id of such a piece starts with a space. Texts with other
    whitespace or with a special token of the tokenizer's are given to the library whole. The ids of the pieces seen last,
    twice `keep` at most, are remembered.
    """

    def __init__(self, path: str, keep: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values(), default=0) < 65_536 else "<u4"
        self.whole_for = [*_ODD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0] if self.tokenizer.pre_tokenizer else " "
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.spelled = self._spelled()
        self.letters = re.compile(" [" + "".join(map(chr, self.spelled.keys() - {32})) + "]+") if self.spelled else re.compile(r"(?!)")
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _spelled(self) -> dict[int, str]:
        """The model's spelling of a space and of each letter below U+0250 that stays in one match with the letters around it."""
        split = self.tokenizer.pre_tokenizer
        if split is None or self.tokenizer.normalizer is not None:
            return {}
        out = {}
        for c in filter(str.isalpha, map(chr, range(0x250))):
            found = [x for x, _ in split.pre_tokenize_str(f" a{c}Z{c}{c}")]
            if len(found) == 1 and found[0][1] == "a" and [x for x, _ in split.pre_tokenize_str(f" {c}")] == [found[0][0] + (own := found[0][2 : found[0].index("Z", 2)] or c)]:
                out[ord(c)], out[32] = own, found[0][0]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        code = self.kind[1:] == "u2" and "H" or "I"  # little-endian machines, as Spark's executors are
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1]
        code, tokenize = self.kind[1:] == "u2" and "H" or "I", self.tokenizer.model.tokenize
        out = {p: array(code, [t.id for t in tokenize(p.translate(self.spelled))]).tobytes() for p in filter(self.letters.fullmatch, spaced)}
        spaced = [p for p in spaced if p not in out]
        if len(spaced) > 1:
            ids = np.frombuffer(self._library(["".join(spaced)])[0], self.kind)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(spaced):
                ends = np.append(first[1:], len(ids)) * ids.itemsize
                data = ids.tobytes()
                out |= {p: data[a:b] for p, a, b in zip(spaced, (first * ids.itemsize).tolist(), ends.tolist())}
        rest = [p for p in pieces if p not in out]
        return out | dict(zip(rest, self._library(rest)))

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        if text[0] in " \n" or text[-1] == "\n" or any(x in text for x in self.whole_for) or not text.isascii() and any(x in text for x in _ODD_WIDE):
            return np.frombuffer(self._library([text])[0], self.kind)
        if len(self.known) > self.keep:
            self.known, self.older = {"": b""}, self.known
        if not _RUN_OF_MARKS.search(text):
            for mark in (". ", ", ", ".\n", ",\n"):
                text = text.replace(mark, "\0" + mark)
        parts = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        found = list(map(self.known.get, parts))
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            missing = {parts[i] for i in holes}
            back = {p: ids for p in missing if (ids := self.older.get(p)) is not None}
            if len(back) < len(missing):
                back |= self._new_pieces(list(missing - back.keys()))
            self.known.update(back)
            for i in holes:
                found[i] = back[parts[i]]
        return np.frombuffer(b"".join(found), self.kind)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ---- operator --------------------------------------------------------------------------------------

WRITTEN = "file string, n_docs long, n_ids long"
READ = "file string, doc_id long, at long, local_start long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by the end id, in ascending doc_id order; returns the list of files."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    width = shuffle_width(spark)
    rows = with_ordered_part(rows, "doc_id", F.xxhash64("text"), width, "bucket")
    ordered = rows.repartitionById(width, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(tokenizer_path)
        fs, root = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], coder.kind)
        bucket, sequence, docs_, counts, chunks, held = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs_, counts, chunks, held, sequence
            name = f"ids-{bucket:08d}-{sequence:05d}.s8b"
            data = to_file(docs_, counts, np.concatenate(chunks))
            temp = f"{root}/.{name}.{os.getpid()}.tmp"
            with fs.open_output_stream(temp) as out:
                out.write(data)
            try:
                fs.move(temp, f"{root}/{name}")
            except OSError:  # a store whose rename does not replace; an earlier try of this task wrote the same bytes
                if fs.get_file_info(f"{root}/{name}").size != len(data):
                    raise
                fs.delete_file(temp)
            line = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs_)], pa.int64()), pa.array([held], pa.int64())], ["file", "n_docs", "n_ids"])
            docs_, counts, chunks, held = [], [], [], 0
            sequence += 1
            return line

        for batch in slices(batches):
            for b, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))):
                if docs_ and (b != bucket or held >= FILE_IDS):
                    yield flush()
                if b != bucket:
                    bucket, sequence = b, 0
                ids = coder.ids(text)
                docs_.append(doc)
                counts.append(len(ids) + 1)
                chunks += [ids, end]
                held += len(ids) + 1
        if docs_:
            yield flush()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return written(ordered.select("bucket", "doc_id", "text").mapInArrow(run, WRITTEN), "id-files")


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document of the files: its place in its file, its place among all ids, its ids' count and checksum."""
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                docs, counts, ids = from_file(data)
                ends = np.cumsum(counts)
                plain = ids.astype("<u4")
                crcs = [zlib.crc32(plain[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["file", "doc_id", "at", "local_start", "n_tokens", "ids_crc32"],
                )

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    rows = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, READ)
    # one row per file: the only total order is over these few
    before = files.select("file", (F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "file")


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written as Simple-8b files in doc_id order and read back."""
    import public_tokenizers

    from ledgerline.llm.common import read_table

    folder = new_path(spark, "packed-ids")
    files = write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, files)
