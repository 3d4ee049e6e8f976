import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import cases
import corpus_pipeline as cp
from ledgerline.llm import bpe_codec
from ledgerline.llm import decontaminate as dc
from ledgerline.llm import quality_pu as qp
from ledgerline.llm.align import local_alignment, plain_words
from test_similarity import edited, plain_classes
from test_secrets import plain_base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    """Documents with junk, near and exact copies, passages of the benchmark and secrets; labels; a benchmark."""
    rng = random.Random(13)
    texts = [cases.prose(i + 1, 60 + i % 50) for i in range(240)]
    items = {k: cases.prose(4000 + k, 30) for k in range(6)}
    for i in range(0, 240, 6):
        texts[i] = " ".join(w + "***" for w in texts[i].split())
    for i in range(1, 240, 12):
        texts[i] = edited(texts[i + 1].split(), rng, i % 3)
    for k, i in enumerate(range(4, 240, 40)):
        texts[i] += " " + (items[k % 6] if k % 2 else edited(items[k % 6].split(), rng, 4)) + " " + cases.prose(900 + i, 20)
    for i in range(5, 240, 30):
        texts[i] += f" password: {'Ab1' * 5}{i} and {'0af3' * 6} end"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None), (500, None, None, None, None), (501, "", "en", "s", 0), (502, " \n", "en", "s", 2), (3, texts[3], "en", "s", len(texts[3]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(240) if i // 6 % 2] + [(7, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items.items(), (90, None), (91, "word"), (None, "no id here at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))


def test_each_stage_against_a_plain_version(spark, tmp_path):
    folder = str(tmp_path)
    items = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(cp.STAGES)

    model, prior = qp.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = stages["quality"](spark, docs, folder)
    want = [r for r in rows_of(docs) if model.scores(np.array([qp.features(r.text or "")], np.float64))[0] >= qp.KEEP_FROM]
    assert rows_of(good) == want and good.schema == docs.schema
    assert sum(r.doc_id is not None and r.doc_id < 240 and r.doc_id % 6 == 0 for r in want) <= 4 and sum(r.doc_id is not None and r.doc_id < 240 for r in want) > 190

    one = stages["near_duplicates"](spark, good, folder)
    mine = rows_of(good)
    least = {}
    for (doc, _, component), r in zip(plain_classes([(r.doc_id, r.text) for r in mine]), mine):
        least.setdefault(doc, []).append(component)
    want = [r for r in mine if r.doc_id is None or not any(c is not None and c != r.doc_id for c in least[r.doc_id])]
    assert rows_of(one) == want and one.schema == docs.schema and len(want) < len(mine) - 10

    clean = stages["decontamination"](spark, one, folder)
    words = sorted({w for t in [*items.values(), "word", "no id here at all"] for w in plain_words(t)})
    code = {w: i for i, w in enumerate(words)}
    queries = [np.array([code[w] for w in plain_words(t)]) for t in [*items.values(), "no id here at all"]]

    def hit(text):
        b = np.array([code.get(w, -1) for w in plain_words(text)], np.int64)
        found = [(local_alignment(q, b, -len(q), len(b)), len(q)) for q in queries] if len(b) else []
        return any(a.matched > 1 and a.score >= dc.LEAST * 2 * n for a, n in found)

    want = [r for r in rows_of(one) if not hit(r.text)]
    assert rows_of(clean) == want and len(want) <= len(rows_of(one)) - 4

    masked = stages["secrets"](spark, clean, folder)

    def hidden(text):
        cut = sorted((re.search(r"[:=] *[\"']?", text[s:e]).end() + s if k == "assign" else s, e) for s, e, k in plain_base(text))
        for s, e in reversed(cut):
            text = text[:s] + "[SECRET]" + text[e:]
        return text

    for before, after in zip(rows_of(clean), rows_of(masked)):
        assert after.doc_id == before.doc_id and after.text == (None if before.text is None else hidden(before.text))
        assert after.n_chars == (before.n_chars if after.text is None else len(after.text))
    assert sum("[SECRET]" in (r.text or "") for r in rows_of(masked)) >= 3

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in stages["tokens"](spark, masked, folder).collect())
    want = []
    for r in rows_of(masked):
        ids = codec.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, np.array(ids, "<u4").tobytes(), len(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in cp.run(spark, folder).collect()) == got


def test_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows, very long texts and columns whose names operators use inside; and tables without rows."""
    corpus(spark, str(tmp_path))
    docs, empty = cases.documents(spark), cases.empty(spark)
    for name, stage in cp.STAGES:
        made, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        if name != "tokens":
            assert made.schema == docs.schema == none.schema, name
        assert made.count() > 0 and none.count() == 0, name
    ids = sorted(r.doc_id for r in dict(cp.STAGES)["near_duplicates"](spark, docs, "").collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 6, 9, 10, 11, 12, 13]


def test_tokens_keep_one_worker_a_task(spark):
    """Encoding and decoding in a pass each kept two Python workers in every task slot."""
    docs = cases.documents(spark)
    made = dict(cp.STAGES)["tokens"](spark, docs, "")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = bpe_codec.decode(bpe_codec.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert made.exceptAll(plain.select("doc_id", "n_tokens", "ids", F.sha2("bytes", 256).alias("decoded_sha256"))).isEmpty() and made.count() == docs.count()
