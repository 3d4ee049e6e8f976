"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

`encode` gives each row's ids, `decode` the bytes that ids stand for. Texts above `LONG` characters are cut where every
match of a pattern of this family ends: before white space that follows something else, and between certain letters,
digits and marks (but not from a mark to a letter, which may be a contraction). So the pieces' ids in a row are the ids of
the whole text.

A long run of white space is one match but for its last character, which belongs to what follows it; at the end of a text
it is one match. The library's matcher keeps a place for each of its characters and overflows, so runs of `BLANKS` or more
are not given to the matcher but encoded as the one piece that they are.

Cases: a null or empty text has no ids and decodes to no bytes; null keys and repeated rows are kept as they are; an
empty table gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from ledgerline.llm.common import id_and_text, slices

#: Characters from which a text is cut into pieces of about this length.
LONG = 65_536
#: White space of so many characters is encoded without the matcher.
BLANKS = 4096

#: White space as Unicode has it, which is what the library's patterns call \\s; some letters and marks that all versions of Unicode call so.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_SAFE = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[{_LETTER}])(?=[0-9{_MARK}])|(?<=[0-9])(?=[{_LETTER}{_MARK}])")
_BLANKS = re.compile(rf"[{_WHITE}]{{{BLANKS},}}")

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, bytes binary"


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(f"local:{rank_path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, length: int = LONG) -> Iterator[str]:
    """The text in pieces whose encodings in a row are the whole's."""
    start = 0
    while len(text) - start > length and (cut := _SAFE.search(text, start + length)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def matched_pieces(text: str) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match by itself) in order."""
    start = 0
    if len(text) >= BLANKS:
        for blanks in _BLANKS.finditer(text):
            end = blanks.end() if blanks.end() == len(text) else blanks.end() - 1
            if blanks.start() > start:
                yield from ((piece, False) for piece in pieces(text[start : blanks.start()]))
            yield text[blanks.start() : end], True
            start = end
    if start < len(text):
        yield from ((piece, False) for piece in pieces(text[start:] if start else text))


def encode_text(text: str, codec: tiktoken.Encoding) -> np.ndarray:
    parts = [np.array(codec._encode_single_piece(piece.encode()) if whole else codec.encode_ordinary(piece), "<u4") for piece, whole in matched_pieces(text)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, "<u4")


def _encoded(batch: pa.RecordBatch, codec: tiktoken.Encoding) -> pa.RecordBatch:
    ids = [encode_text(text, codec) for text in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
        ["doc_id", "n_tokens", "ids"],
    )


def _decoded(batch: pa.RecordBatch, codec: tiktoken.Encoding) -> pa.RecordBatch:
    data = [codec.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "bytes"])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_path, pattern)
        for batch in slices(batches):
            yield _encoded(batch, codec)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The raw bytes that each row's ids stand for, beside the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_path, pattern)
        for batch in slices(batches):
            yield _decoded(batch, codec)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `decode` gives of what `encode` gives. Both run in one Python worker of a task; a pass for each would keep two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(rank_path, pattern)
        for batch in slices(batches):
            yield _decoded(_encoded(batch, codec), codec)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DECODED)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op5_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids and of the bytes that they decode to."""
    import public_tokenizers

    from ledgerline.llm.common import read_table

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    from pyspark.sql import functions as F

    decoded = decode(encode(read_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
