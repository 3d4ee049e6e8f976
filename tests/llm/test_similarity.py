import hashlib
import itertools
import random
from collections import Counter

import numpy as np

import cases
from ledgerline.llm import decontaminate as dc
from ledgerline.llm import jaccard_trees as jt
from ledgerline.llm import license_scan as ls
from ledgerline.llm import syncmers as sm
from ledgerline.llm.align import local_alignment, plain_words
from ledgerline.llm.common import WordHashes, shingle_set


def plain_classes(rows):
    """Component per row by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jt, "OFTEN_IN_CHUNK", 3)
    rng = random.Random(4)
    texts, base = [], cases.prose(1, 120).split()
    passage = cases.prose(99, 60)
    for i in range(60):
        texts.append(edited(base, rng, rng.randrange(0, 6)))  # a group around one text, some pairs below the limit
    for i in range(40):
        texts.append(cases.prose(200 + i, 30 + i * 3) + " " + passage)
    for i in range(30):
        own = cases.prose(300 + i // 3, 20 + 7 * i // 3).split()
        texts.append(edited(own, rng, i % 3))
    texts += [t for t in cases.TEXTS.values()] + [texts[0]] * 5 + ["a b c d", "A  b\tc d", "a b c d e", "x"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, "alone without an id at all here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jt.jaccard_classes(docs).collect())
    assert got == Counter(plain_classes(rows))


def class_rows(docs, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jt.jaccard_classes(docs, **options).collect())


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jt, "OFTEN_IN_CHUNK", 3)
    rng = random.Random(5)
    base = cases.prose(1, 150).split()
    rows = [(i, edited(base, rng, 1 + i % 3)) for i in range(50)]
    other = edited(base, rng, 9).split()
    rows += [(100 + i, edited(other, rng, 1 + i % 4)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert class_rows(docs, cell_bytes=20_000) == class_rows(docs) == Counter(plain_classes(rows))


def test_null_ids_and_repeated_ids_link_others(spark):
    rng = random.Random(7)
    first = cases.prose(1, 200).split()
    bridge, last = edited(first, rng, 3).split(), None
    last = edited(bridge, rng, 3)
    rows = [(1, " ".join(first)), (2, last), (None, " ".join(bridge)), (5, cases.prose(50, 90)), (5, cases.prose(51, 90)), (9, edited(cases.prose(51, 90).split(), rng, 1)), (3, edited(cases.prose(50, 90).split(), rng, 1))]
    want = plain_classes(rows)
    assert Counter(want)[(2, want[1][1], 1)] == 1 and {c for d, _, c in want if d == 9} == {5}
    assert class_rows(spark.createDataFrame(rows, "doc_id long, text string")) == Counter(want)


def test_five_thousand_near_copies_make_few_links(spark):
    rng = random.Random(8)
    base = cases.prose(3, 60).split()
    sets = list({s.tobytes(): s for s in (shingle_set(edited(base, rng, 1), WordHashes()) for _ in range(5000))}.values())
    cell = jt.Cell(sets, list(range(len(sets))))
    assert len(cell.links) == len(sets) - len(set(cell.label.tolist())) <= len(sets) - 1


def linked_by_pairs(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def test_cell_finds_every_component(monkeypatch):
    rng = random.Random(6)
    hashes, sets = WordHashes(), []
    for g in range(12):
        base = cases.prose(g // 2 + 1, 20 + 30 * g).split()
        sets += [shingle_set(edited(base, rng, k), hashes) for k in range(9)]
    want = linked_by_pairs(sets)
    for tokens in (4096, 64):  # with bits of their own for all shared shingles, and hashed bits for most
        monkeypatch.setattr(jt, "TOKENS", tokens)
        cell = jt.Cell(sets, list(range(len(sets))))
        same = lambda labels: {tuple(x == y for y in labels) for x in labels}
        assert same(cell.label.tolist()) == same(want)
        assert len(cell.links) == len(sets) - len(set(want))
    tree = jt.SignatureTree(cell.sizes, np.concatenate([cell.exact, cell.hashed], 1), cell.collisions, np.arange(len(cell.at)))
    left = {(min(a, b), max(a, b)) for i, j in jt.possible_pairs(tree) for a, b in zip(cell.at[i].tolist(), cell.at[j].tolist())}
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= left and len(left) < len(sets) * (len(sets) - 1) // 4


def test_one_of_each_and_empty(spark):
    docs = cases.documents(spark)
    kept = jt.one_of_each(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 6, 6, 9, 10, 11, 12, 13]
    assert jt.jaccard_classes(cases.empty(spark)).count() == 0


def test_fingerprints_and_next_texts(spark, tmp_path):
    texts = dict(cases.TEXTS)
    texts.update({i: cases.prose(i, 20 + 13 * i) for i in range(20, 60)})
    docs = cases.documents(spark, texts).unionByName(cases.documents(spark, {None: "no id"}))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in sm.op4_syncmers(spark, str(tmp_path)).collect()}
    texts[None] = "no id"
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    assert set(rows) == set(order)
    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(own) // 3
        want = own[: len(own) - third] + nxt[:third]
        assert rows[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[i].n_chars == len(own)
    assert rows[6].fingerprint == rows[7].fingerprint and rows[1].fingerprint == rows[2].fingerprint == ""
    long = [r for i, r in rows.items() if i and i >= 20]
    assert min(r.near_edited for r in long) > 0.25 and max(r.near_next for r in long) < 0.1
    assert sm.fingerprints(cases.empty(spark)).count() == 0
    alone = cases.documents(spark, {5: "just one document here"}).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    assert alone is None and sm.op4_syncmers(spark, str(tmp_path / "one")).first().near_next == 1.0


def test_syncmers_against_the_definition(spark):
    top = 2**63 - 1
    texts = [cases.prose(5, n) for n in (1, 2, 3, 5, 6, 7, 31, 32, 127, 128, 300)] + ["a a a a a a a a", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in sm.with_anchors(df, "t", "a").select("t", "a", sm.unit_hashes(sm.F.col("t")).alias("h")).collect():
        padded = [top] * (sm.K - 1) + row.h + [top] * (sm.K - 1)
        grams = [padded[i : i + sm.K] for i in range(len(row.h) + sm.K - 1)]
        want = [i + 2 - sm.K for i, g in enumerate(grams) if min(g) in (g[0], g[-1])]
        assert [x.p for x in row.a] == want and len(want) >= 2, row.t[:40]
        same = {}
        for x in row.a:
            assert same.setdefault(tuple(padded[x.p + sm.K - 2 :][: sm.K]), x.v) == x.v


def test_units_are_runs_between_any_blanks_and_their_pieces(spark):
    solid = "\u00e9\u6f22\u5b57q" * 30
    texts = [" a\t\nb\x0bc\x0cd \r e\u00a0f ", "a b c d e\u00a0f", solid, "x " + solid + "\n", "", " \n "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b, c, d, e, f = (r.h for r in df.select(sm.unit_hashes(sm.F.col("t")).alias("h")).collect())
    assert a == b and len(a) == 5 and len(c) > 5 and d[1:] == c and e == f == []


def test_likeness_is_that_of_the_fingerprints(spark, tmp_path):
    """All near_... of the query against sets read from the fingerprints that it returns."""
    texts = {i: cases.prose(i % 17 + 1, 3 + 11 * i) for i in range(1, 40)} | cases.TEXTS
    cases.documents(spark, texts).unionByName(cases.documents(spark)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(sm.op4_syncmers(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    hashes = lambda text: {x.split(".")[1] for x in text.split(" ")} if text else set()
    like = lambda x, y: len(x & y) / len(x | y) if x and y else float(len(x) == len(y))
    nexts = {}
    for r in rows:
        nexts.setdefault(r.doc_id, set()).add(frozenset(hashes(r.fingerprint)))
    ids = list(nexts)
    for r in rows:
        own = hashes(r.fingerprint)
        assert abs(r.near_edited - like(own, hashes(r.edited_fingerprint))) < 1e-12
        following = nexts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] | nexts[r.doc_id]  # repeated ids stand beside each other
        assert any(abs(r.near_next - like(own, x)) < 1e-12 for x in following)


def test_no_jump_at_any_length(spark):
    base = cases.prose(44, 140).split()
    rows = [(n, " ".join(base[: n + 1]), " ".join(base[:n])) for n in range(1, 140)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = sm.with_anchors(sm.with_anchors(df, "a", "x"), "b", "y").select("n", sm.likeness(sm.hashes_of(sm.F.col("x")), sm.hashes_of(sm.F.col("y"))).alias("like"), sm.matched(sm.F.col("x"), sm.F.col("y")).alias("m"))
    for r in df.collect():
        assert r.like >= (1 - 12 / (r.n / 3 + 12) if r.n >= 20 else 0.05) and sum(x.a != x.b for x in r.m) <= 2, (r.n, r.like)


def test_alignment_against_the_full_table():
    rng = random.Random(8)
    for _ in range(60):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 15))])
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(0, 20))])
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                best = max(best, h[i + 1][j + 1])
        got = local_alignment(a, b, -len(a), len(b))
        assert got.score == best
        assert got.matched <= min(got.a_end - got.a_start, got.b_end - got.b_start)


def test_copies_of_items_are_found_and_others_are_not(spark):
    rng = random.Random(9)
    items = {i: cases.prose(1000 + i, 40) for i in range(12)}
    docs = {i: cases.prose(i, 300) for i in range(40)}
    docs[3] += " " + items[1] + " " + cases.prose(77, 50)
    docs[4] = items[2].upper()
    docs[5] += " " + edited(items[3].split(), rng, 6) + " tail words"
    docs[6] = items[4] + " " + docs[6] + " " + items[4]
    bench = spark.createDataFrame([*items.items(), (None, "nothing like any text anywhere"), (50, None), (51, ""), (52, "word")], "item_id long, text string")
    table = cases.documents(spark).unionByName(cases.documents(spark, {i + 100: t for i, t in docs.items()}))
    found = dc.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(103, 1), (104, 2), (105, 3), (106, 4)} and sum(r.item_id == 4 for r in found) == 2
    exact = next(r for r in found if r.item_id == 1)
    assert exact.score == 1.0 and plain_words(docs[3])[exact.start_word : exact.end_word] == plain_words(items[1])
    kept = dc.drop_contaminated(table, bench)
    assert kept.schema == table.schema and {r.doc_id for r in table.collect()} - {r.doc_id for r in kept.collect()} == {103, 104, 105, 106}
    assert dc.contaminated(cases.empty(spark), bench).count() == 0 and dc.contaminated(table, bench.limit(0)).count() == 0
    assert len(dc.item_blocks(bench, 600)) > 2


def test_licences(spark):
    text = cases.prose(5, 200)
    docs = {1: text + "\n" + ls.TEMPLATES["MIT grant"].replace("software", "code", 1), 2: ls.TEMPLATES["Apache-2.0 line"] + ".", 3: text, 4: text + " " + " ".join(ls.TEMPLATES["BSD conditions"].split()[:6])}
    found = {(r.doc_id, r.template): r for r in ls.scan(cases.documents(spark).unionByName(cases.documents(spark, {k + 100: v for k, v in docs.items()}))).collect()}
    assert set(found) == {(101, "MIT grant"), (102, "Apache-2.0 line")}
    r = found[101, "MIT grant"]
    assert r.start_word == 200 and 0.9 < r.coverage < 1 and r.matched == r.end_word - r.start_word - 1
    assert ls.scan(cases.empty(spark)).count() == 0 and ls.scan(cases.documents(spark), {"none": "..."}).count() == 0
    hashes = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    kept = set(ls.winnowed(hashes, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(397))


def test_every_template_at_the_end_of_a_text():
    index = ls.Index(ls.TEMPLATES)
    for name, template in ls.TEMPLATES.items():
        for seed in range(20):
            text = cases.prose(seed + 1, 60) + " " + template
            found = {x[0]: x for x in index.matches(text)}
            assert name in found and found[name][1] == 1.0 and found[name][4] == len(plain_words(text)), (name, seed)


def test_templates_with_every_fifth_or_fourth_word_replaced():
    index = ls.Index(ls.TEMPLATES)
    for name, template in ls.TEMPLATES.items():
        for every in (4, 5):
            words = plain_words(template)
            if len(words) < 9:
                continue
            for i in range(every - 1, len(words), every):
                words[i] = f"new{i}".encode()
            text = cases.prose(3, 60) + " " + b" ".join(words).decode() + " " + cases.prose(4, 60)
            want = sum(not w.startswith(b"new") for w in words)
            assert any(x[0] == name and x[2] == want for x in index.matches(text)), (name, every)


def test_copies_side_by_side_and_many():
    index = ls.Index(ls.TEMPLATES)
    for name, n in (("All rights reserved", 400), ("GPL-2.0-or-later notice", 60)):
        found = [x for x in index.matches(f"{ls.TEMPLATES[name]} " * n) if x[0] == name]
        size = len(plain_words(ls.TEMPLATES[name]))
        assert [x[3:5] for x in found] == [(i * size, (i + 1) * size) for i in range(n)]


def test_edited_copies_are_found_however_large_the_corpus(spark, monkeypatch):
    plain, factor = dc.word_counts, 10**9

    def of_a_large_corpus(docs, wanted):
        counts, total = plain(docs, wanted)
        return {w: n * factor for w, n in counts.items()}, total * factor

    monkeypatch.setattr(dc, "word_counts", of_a_large_corpus)
    items, docs = {}, {}
    for i in range(30):
        items[i] = cases.prose(2000 + i, 40)
        words = items[i].split()
        for j in range(2, 40, 3 + i % 2):
            words[j] = f"new{i}x{j}"
        docs[i] = cases.prose(i + 1, 80) + " " + " ".join(words) + " " + cases.prose(i + 500, 80)
    table = cases.documents(spark, docs)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in dc.contaminated(table, bench).collect()}
    assert set(found) == {(i, i) for i in docs} and min(r.score for r in found.values()) >= 0.45
    assert dc.drop_contaminated(table, bench).count() == 0


def test_every_alignment_that_scores_enough_has_a_seed():
    rng, some = random.Random(12), 0
    for _ in range(300):
        words = [f"w{x}".encode() for x in range(rng.choice([6, 12, 40]))]
        items = [(k, [rng.choice(words) for _ in range(rng.randrange(3, 14))]) for k in range(3)]
        text = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        for w in rng.choice(items)[1]:  # a copy with words put in, replaced and left out
            text += rng.choice([[w], [w], [w, b"x"], [b"y"], []])
        text += [rng.choice(words) for _ in range(rng.randrange(0, 10))]
        seeds = dc.Seeds(items, {w: rng.randrange(1000) for w in words}, 10**6)
        found = {x[0]: x[1] for x in sorted(seeds.alignments(b" ".join(text).decode()), key=lambda x: x[1])}
        for k, ids in enumerate(seeds.ids):
            b = np.array([seeds.vocabulary.get(w, 0) for w in text], np.int64)
            best = local_alignment(ids, b, -len(ids), len(b)).score / (2 * len(ids))
            assert found.get(k) == (best if best >= dc.LEAST else None)
            some += best >= dc.LEAST
    assert 100 < some < 890


def test_likeness_of_shifted_and_unspaced_texts(spark):
    base, other = cases.prose(40, 600), cases.prose(41, 600)
    solid, far = base.replace(" ", ""), other.replace(" ", "")
    short = cases.prose(42, 130)
    texts = [
        (base, cases.prose(43, 40) + " " + base, 0.85, 1.0),  # forty words before it
        (base, " ".join(base.split()[40:]), 0.85, 1.0),
        (solid, "x" + solid, 0.9, 1.0),
        (solid, solid[:2000] + "q" + solid[2000:], 0.8, 1.0),
        (short, " ".join(short.split()[5:]), 0.8, 1.0),
        (base, other, 0.0, 0.05), (solid, far, 0.0, 0.05), ("", "", 1.0, 1.0), ("", base, 0.0, 0.0), ("a b", base, 0.0, 0.0), ("", "a b", 0.0, 0.0),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string, low double, high double")
    df = sm.with_anchors(sm.with_anchors(df, "a", "x"), "b", "y").withColumn("like", sm.likeness(sm.hashes_of(sm.F.col("x")), sm.hashes_of(sm.F.col("y"))))
    assert not [(r.i, r.like) for r in df.collect() if not r.low <= r.like <= r.high]


def test_short_items_need_telling_words(spark):
    common = {w: 50_000 for w in b"what is the of it in a to and for we this that with on was".split()} | {b"capital": 40, b"city": 90, b"france": 60, b"invented": 30, b"telephone": 20, b"who": 9_000, b"boiling": 25, b"point": 300, b"water": 800}
    items = ["What is the capital city", "What is the capital of France", "Who invented the telephone", "the boiling point of water", "is it the", "what is the best of the best in the city"]
    seeds = dc.Seeds([(i, plain_words(t)) for i, t in enumerate(items)], common, 1_000_000)
    clean = [
        "what is this thing we saw in the garden", "it is the best of water sports", "so what is the name of the man who was here", "the point is that it is the water", "who was the one that is the telephone man", "is the water in the city what we want",
        "this is what it is in the end and that was the point of it", "what is the plan for this city of ours",
    ]
    for text in clean:
        assert [x for x in seeds.copies(text) if x[0] != 4] == [], text
    assert seeds.alignments(clean[0]) and seeds.alignments(clean[1])  # they score enough, but do not tell
    for i, item in enumerate(items[:4]):
        assert [x[:2] for x in seeds.copies(f"they asked: {item}? and so on") if x[0] == i] == [(i, 1.0)]
    assert {x[0] for x in seeds.copies("tell me what is the big capital of France now")} >= {1}
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = cases.documents(spark, {i: t + " " + cases.prose(i, 100) for i, t in enumerate(clean)})
    kept = dc.drop_contaminated(docs, bench.where("item_id = 0"))
    assert kept.count() == len(clean)


def test_alignment_of_long_items_keeps_few_rows():
    import tracemalloc

    rng = random.Random(3)
    a = np.array([rng.randrange(5000) for _ in range(6000)])
    b = np.concatenate([np.array([rng.randrange(5000) for _ in range(200)]), np.delete(a, range(0, 6000, 9)), np.array([7] * 50)])
    tracemalloc.start()
    got = local_alignment(a, b, -1000, 1500)
    assert tracemalloc.get_traced_memory()[1] < 12e6
    tracemalloc.stop()
    assert got.matched == 6000 - len(range(0, 6000, 9)) and list(got.at) == sorted(set(got.at)) and len(got.at) == got.matched


def test_windows_prove_a_hit():
    index = ls.Index(ls.TEMPLATES)
    rng = random.Random(6)
    windowed = 0
    for name, template in ls.TEMPLATES.items():
        words = plain_words(template)
        codes = index.hashes.array(words)
        lost = 0 if len(words) < ls.SHORT else len(words) - int(np.ceil(ls.LEAST * len(words)))
        size, kept, at = ls.fingerprints(codes, lost)
        windowed += len(at) < len(words) - size + 1
        assert ls.apart(at, size) > lost
        for _ in range(200):  # the words to lose, anywhere
            gone = set(rng.sample(range(len(words)), lost))
            assert any(not gone & set(range(p, p + size)) for p in at.tolist()), name
    assert windowed >= 8
    for n in (8, 9, 11, 14, 30):  # every place of the fewest edits for small ones
        codes = np.array([rng.randrange(2**60) for _ in range(n)], np.uint64)
        lost = n - int(np.ceil(ls.LEAST * n))
        size, _, at = ls.fingerprints(codes, lost)
        for gone in itertools.combinations(range(n), lost) if n <= 14 else []:
            assert any(not set(gone) & set(range(p, p + size)) for p in at.tolist())


def plain_licences(index, text):
    """Full alignment of every template to the whole text, best first, then what is left on both sides."""
    codes, out = index.hashes.array(plain_words(text)).view(np.int64), []
    for name, query in zip(index.names, index.words):
        pieces = [(0, len(codes))]
        while pieces:
            low, high = pieces.pop()
            x = local_alignment(query, codes[low:high], -len(query), high - low)
            whole = x.matched == len(query) == x.b_end - x.b_start if len(query) < ls.SHORT else x.matched >= ls.LEAST * len(query)
            if x.score and whole:
                out.append((name, x.matched, low + x.b_start, low + x.b_end))
                pieces += [(low, low + x.b_start), (low + x.b_end, high)]
    return out


def test_licences_against_full_alignments():
    index, rng, seen, missed, extra = ls.Index(ls.TEMPLATES), random.Random(11), 0, 0, 0
    for k in range(60):
        name = rng.choice(sorted(ls.TEMPLATES))
        words, kind = ls.TEMPLATES[name].split(), k % 3
        if len(plain_words(ls.TEMPLATES[name])) >= ls.SHORT:
            for i in rng.sample(range(len(words)), len(words) // 8):
                words[i] = {0: f"new{i}", 1: "", 2: f"{words[i]} put in"}[kind]
        text = f"{cases.prose(k + 1, 40)} {' '.join(words)} {cases.prose(k + 2, 40)}"
        want, got = plain_licences(index, text), {(x[0], x[2]) for x in index.matches(text)}
        seen += len(want)
        missed += sum(x[:2] not in got for x in want)
        extra += len(got) - len(want)
        best = index.best(text)
        assert best and best[0][2] == max(x[1] for x in want)  # the template with the most matched words stands for its place
    assert seen > 60 and missed <= 0.02 * seen and extra <= 0.02 * seen


def test_one_template_for_a_place():
    index = ls.Index(ls.TEMPLATES)
    names = lambda text: [x[0] for x in index.best(text)]
    assert names("x Licensed under CC BY-NC 4.0 y") == ["CC-BY-NC line"] and names("Licensed under CC BY 4.0") == ["CC-BY line"]
    assert names("we license this under the GNU General license agreement") == [] and names("licensed under CC and by 4 0 percent") == []
    assert names(ls.TEMPLATES["Apache-2.0 notice"] + " and All rights reserved.") == ["Apache-2.0 notice", "All rights reserved"]
    assert names(ls.TEMPLATES["MIT"]) == ["MIT"] and names(ls.TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"] and names(ls.TEMPLATES["ISC"]) == ["ISC"]
    assert names(ls.TEMPLATES["GPL-2.0-or-later notice"]) == ["GPL-2.0-or-later notice"]
    assert names(ls.TEMPLATES["MIT grant"]) == ["MIT grant"] and names("one word") == []
    assert [x[0] for x in ls.Index({"w": "copyleft"}).best("all of it is Copyleft, as copyleft goes")] == ["w", "w"]
    import time

    began = time.time()
    assert len(index.best("All rights reserved. " * 20_000)) == 20_000 and time.time() - began < 10


def test_classes_with_every_join_by_a_shuffle(spark, monkeypatch):
    """More clusters than are broadcast: their texts are fetched, and all else joined, by shuffles."""
    monkeypatch.setattr(jt, "FEW", 0)
    rng = random.Random(8)
    base = cases.prose(2, 120).split()
    rows = [(i, edited(base, rng, rng.randrange(0, 4))) for i in range(12)] + [(20, "few words"), (21, None), (None, " ".join(base)), (22, cases.prose(3, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (jt.CELL_BYTES, 8_000):
        got = [tuple(r) for r in jt.jaccard_classes(docs, size).collect()]
        assert sorted(got, key=str) == sorted(plain_classes(rows), key=str)
