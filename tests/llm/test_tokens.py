import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

import cases
from ledgerline.llm import bpe_codec, packed_ids
from ledgerline.llm.common import new_path


def test_pack_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 59, 60, 61, 1024, 1025, 5000):
        for top in (1, 2, 9, 60, 2**20, 2**59, 2**64):
            ids = np.array([rng.randrange(top) for _ in range(n)], np.uint64)
            words, offsets = packed_ids.pack(ids)
            assert len(offsets) == -(-n // packed_ids.BLOCK)
            assert (packed_ids.unpack(words, offsets, n) == ids).all()
    mixed = np.array([0, 2**63, 5, 2**60 - 1, 2**60, 15 << 60] * 700, np.uint64)
    words, offsets = packed_ids.pack(mixed)
    assert (packed_ids.unpack(words, offsets, len(mixed)) == mixed).all()
    docs, counts, back = packed_ids.from_file(packed_ids.to_file([None, -3], [1000, len(mixed) - 1000], mixed))
    assert docs == [None, -3] and counts.tolist() == [1000, len(mixed) - 1000] and (back == mixed).all()
    dense = np.zeros(6000, np.uint64)
    assert len(packed_ids.pack(dense)[0]) < 6000 / 50


def test_pieces_give_the_librarys_ids():
    coder = packed_ids.PieceEncoder(P.path("byte_bpe_50k.json"), keep=50)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in [t for t in cases.TEXTS.values() if t] + ["a b ", " a", "it 's", "a b<|endoftext|>c d", "one <|endoftext|> two. Three", "x) . y", "end). Next, (so). On_, z", "x. Y\nz", "a\0 \0b"]:
        assert coder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def test_files_hold_all_ids_in_order(spark):
    folder = new_path(spark, "t")
    docs = cases.documents(spark)
    files = packed_ids.write_ids(docs, P.path("byte_bpe_50k.json"), folder)
    got = sorted(packed_ids.read_ids(spark, folder, files).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = new_path(spark, "t")
    assert packed_ids.read_ids(spark, folder, packed_ids.write_ids(cases.empty(spark), P.path("byte_bpe_50k.json"), folder)).count() == 0


def test_codec_equals_tiktoken_and_round_trips(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = cases.documents(spark)
    out = bpe_codec.decode(bpe_codec.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    want = Counter((r.doc_id, np.array(plain.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe_codec.encode(cases.empty(spark), path, P.PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest() == bpe_codec.sha256_hex(b"")
    long = cases.prose(3, 60_000)
    assert len(list(bpe_codec.pieces(long))) > 3 and "".join(bpe_codec.pieces(long)) == long


def plain_codec():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cuts_fall_between_matches(monkeypatch):
    """Every cut of texts of all classes in random order, with pieces and blank runs of a few characters."""
    import regex

    codec, rng, matches = plain_codec(), random.Random(4), regex.compile(P.PATTERN)
    monkeypatch.setattr(bpe_codec, "_BLANKS", bpe_codec.re.compile(bpe_codec._BLANKS.pattern.replace(str(bpe_codec.BLANKS), "3")))
    monkeypatch.setattr(bpe_codec, "BLANKS", 3)
    parts = ["a", "Be", "'s", "'ll", "'", "'re", "1", "23", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\x1c", "\u200b", "!", ")(", "_", "-", "日本", "。", "か", "й", "é", "\u0301", "²", "Ⅷ", "한국", "\U0001f600", "、", "\u2003", "\u30fb"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        monkeypatch.setattr(bpe_codec, "LONG", 2)
        monkeypatch.setattr(bpe_codec.pieces, "__defaults__", (rng.randrange(1, 6),))
        assert bpe_codec.encode_text(text, codec).tolist() == codec.encode_ordinary(text), repr(text)
        ends, at = set(), 0
        for m in matches.finditer(text):
            ends.add(m.end())
        for piece, _ in bpe_codec.matched_pieces(text):
            at += len(piece)
            assert at in ends, (text, at)


def test_very_long_runs_are_encoded():
    codec, blanks = plain_codec(), 2_000_000
    one = codec._encode_single_piece(b" " * (blanks - 1))
    assert bpe_codec.encode_text("a" + " " * blanks + "b", codec).tolist() == [*codec.encode_ordinary("a"), *one, *codec.encode_ordinary(" b")]
    assert bpe_codec.encode_text(" " * blanks, codec).tolist() == codec._encode_single_piece(b" " * blanks)
    assert bpe_codec.encode_text("\n" * blanks + "b", codec).tolist() == codec._encode_single_piece(b"\n" * (blanks - 1)) + codec.encode_ordinary("\nb")
    for text in ("日本語、" * 300_000, "x" * 1_000_000, "1a" * 500_000, "!" * 1_000_000):
        ids = bpe_codec.encode_text(text, codec)
        assert codec.decode_bytes(ids.tolist()) == text.encode()
    assert max(map(len, bpe_codec.pieces("日本語、" * 300_000))) < bpe_codec.LONG + 10


def test_pieces_of_letters_need_no_library_call():
    coder = packed_ids.PieceEncoder(P.path("byte_bpe_50k.json"))
    asked, library = [], coder._library
    coder._library = lambda texts: asked.extend(texts) or library(texts)
    text = "x" + "".join(f" {w}" for w in ("the Straße équipe naïve zebra Łódź ǅ ıIİ don't a1 œuvre日本 " + "ªº ǃ ʰ ɐ é é ZZ").split())
    assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert " équipe" not in "".join(asked) and " don't" in "".join(asked)
    for c in filter(str.isalpha, map(chr, range(0x400))):
        text = f"so {c} {c}{c}a b{c}B {c}1 it{c}"
        assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, c
