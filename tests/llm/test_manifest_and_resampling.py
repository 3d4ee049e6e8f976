import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import cases
from ledgerline.llm import importance as im
from ledgerline.llm import merkle_manifest as mm
from ledgerline.llm.common import numbered, written


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest -----------------------------------------------------------------------------


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, place, current, seen):
    for level in levels[:-1]:
        run, k = level[place // 3 * 3 : place // 3 * 3 + 3], place % 3
        seen += run[:k] + run[k + 1 :]
        current, place = sha("".join(run[:k] + [current] + run[k + 1 :])), place // 3
    return current


def plain_proofs(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    groups = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", ""))) if tampered else None
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in groups}
    top = plain_tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for rank, s in enumerate(order):
        for place, (has_id, i, leaf_hash, changed) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            seen = []
            folded = climb(top, rank, climb(trees[s], place, changed or leaf_hash, seen), seen)
            out.append((i if has_id else None, leaf_hash, trees[s][-1][0], root, sha("".join(seen)), folded, folded == root))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")



@pytest.mark.parametrize("levels", [1, 2, 5])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(mm, "LEVELS", levels)
    monkeypatch.setattr(mm, "BLOCK", 3**levels)
    rows, n = [], 0
    for source, size in (("b", 1), (None, 4), ("a", 3), ("ä", 28), ("hot", 100), ("", 2)):
        for _ in range(size):
            n += 1
            rows.append((n * 7, source, None if n % 5 == 0 else "en", n if n % 4 else None, None if n % 11 == 0 else f"line {n}\nmore\n" if n % 3 else ""))
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, `group` string, leaf string, place long")
    got = Counter(map(tuple, mm.proofs(written(mm.leaves(df), "t")).collect()))
    want = Counter(plain_proofs(rows))
    assert got == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    assert Counter(map(tuple, mm.proofs(written(mm.leaves(docs), "t")).collect())) == Counter(plain_proofs(rows))
    assert mm.proofs(written(mm.leaves(cases.empty(spark)), "t")).count() == 0
    one = docs.where("doc_id = 4")
    row = mm.proofs(written(mm.leaves(one), "t")).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("") and row.verified


def test_numbered(spark):
    df = written(spark.range(1000).selectExpr("id % 7 AS a", "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS b"), "t")
    rows = numbered(df, "a", "b").collect()
    assert sorted(r.place for r in rows) == list(range(1000))
    in_order = [(r.a, r.b is not None, r.b or 0) for r in sorted(rows, key=lambda r: r.place)]
    assert in_order == sorted(in_order)
    assert numbered(df.limit(0), "a").count() == 0


# ---- importance resampling -----------------------------------------------------------------------

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    found = PLAIN_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def plain_resample(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    docs = [(i, n, [bucket(f) for f in fs]) for i, (n, fs) in ((i, plain_features(t)) for i, t in rows)]
    s, t = Counter(b for d in docs for b in d[2]), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, bs in docs:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = None if i is None else int(sha(f"7:{i}")[:8], 16)
        out.append([i, len(bs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    eligible = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_resampling_equals_a_plain_version(spark):
    rows = [(i, cases.prose(i + 1, (i * 37) % 300)) for i in range(400)] + [(1000 + i, None if i % 3 else "") for i in range(60)]
    target = [cases.prose(i, 50) for i in range(3, 400, 40)] + [None]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (25, 100, 0):
        assert Counter(map(tuple, im.resample(docs, wanted, percent).collect())) == Counter(plain_resample(rows, target, percent))


def test_resampling_of_awkward_rows(spark):
    docs, none = cases.documents(spark, repeat=False), cases.empty(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, im.resample(docs, none).collect())) == Counter(plain_resample(rows, []))
    assert im.resample(none, docs).count() == 0
    many = docs.where("doc_id = 6").crossJoin(spark.range(50).select()).repartition(3)  # one row fifty times: each rank once
    got = im.resample(many, none).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 13)) and len(got) == 50


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_kth_key(spark, monkeypatch, bits):
    monkeypatch.setattr(im, "DIGIT_BITS", bits)
    keys = sorted((-(i % 9), i * 31 % 57, i) for i in range(300))
    df = spark.createDataFrame(keys, "a long, b long, c long").repartition(3)
    for k in (1, 2, 33, 150, 299, 300):
        assert tuple(im.kth_key(df, ["a", "b", "c"], k)) == keys[k - 1]
    assert im.kth_key(df, ["a", "b", "c"], 0) is None and im.kth_key(df, ["a", "b", "c"], 301) is None
    assert im.kth_key(df.limit(0), ["a", "b", "c"], 1) is None


def test_words_and_buckets():
    text = "It's ÀB été_x1 \0nul 日本語, a-b İ"
    n, features = plain_features(text)
    assert [w.decode() for w in im.words(text)] == features[:n]
    assert im.feature_buckets(im.words(text)).tolist() == [zlib.crc32(f.encode()) % 10000 for f in features]
