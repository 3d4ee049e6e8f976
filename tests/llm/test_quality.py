import zlib

import numpy as np

import cases
from ledgerline.llm import quality_pu as qp


def table(spark, n=600):
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = cases.prose(i + 1, 60 + i % 50)
        docs.append((i, " ".join(w + "***" for w in text.split()) if bad else text))
        if i // 6 % 2:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_risk(spark):
    docs, labels = table(spark)
    model, prior = qp.fit(docs, labels)
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = {r.doc_id: r.score for r in qp.score(docs, model, prior).collect()}
    assert sum((rows[i] >= qp.KEEP_FROM) == (i % 6 != 0) for i in held) >= 0.97 * len(held)
    kept = qp.keep_good(docs, model, prior)
    assert kept.schema == docs.schema and 480 < kept.count() < 520
    folds = {r.doc_id: r.f for r in docs.select("doc_id", qp.fold_of("doc_id").alias("f")).collect()}
    assert {i for i, f in folds.items() if f == 0} == held


def test_only_trusted_positives_are_seen(spark):
    docs, labels = table(spark)
    flipped = labels.where("quality = 1").unionByName(labels.where("quality = 0").selectExpr("doc_id + 100000 AS doc_id", "quality", "toxic"))
    a, p = qp.fit(docs, labels)
    b, q = qp.fit(docs, flipped)
    assert abs(p - q) < 0.1  # which documents the zeros belong to only moves the prior
    x = np.array([qp.features(cases.prose(9, 100))])
    assert abs(a.scores(x)[0] - b.scores(x)[0]) < 0.1


def test_awkward_cases(spark):
    docs, labels = table(spark)
    model, prior = qp.fit(docs, labels)
    awkward = cases.documents(spark)
    rows = qp.score(awkward, model, prior).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert qp.keep_good(awkward, model, prior).schema == awkward.schema
    assert qp.score(cases.empty(spark), model, prior).count() == 0
    none, half = qp.fit(cases.empty(spark), labels.limit(0))
    assert none is None and half == 0.5 and qp.score(awkward, none, half).first().score == 0.5


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    draw = lambda n, good: np.where(good, 1.0, -1.0)[:, None] * 1.5 + rng.normal(size=(n, 6))
    for true in (0.2, 0.5, 0.8):
        u = draw(3000, rng.random(3000) < true)
        assert abs(qp.class_prior(draw(1500, np.ones(1500, bool)), u) - true) < 0.06, true
    assert qp.class_prior(draw(5, np.ones(5, bool)), draw(500, np.ones(500, bool))) == 0.5


def test_labelled_zeros_are_never_read_and_repeated_ids_count_once(spark):
    docs, labels = table(spark)
    a, p = qp.fit(docs, labels)
    b, q = qp.fit(docs, labels.where("quality = 1"))
    x = np.array([qp.features(cases.prose(i, 80)) for i in range(5)])
    assert p == q and (a.scores(x) == b.scores(x)).all() and abs(p - 5 / 6) < 0.08
    one = docs.where("doc_id = 7").crossJoin(spark.range(300).select()).select("doc_id", "text")
    c, r = qp.fit(docs.unionByName(one), labels)
    assert r == p and (c.scores(x) == a.scores(x)).all()


def test_scores_of_the_query_against_a_plain_version(spark):
    """Every row of the query from the model's own arithmetic, text by text; folds and predictions from their definitions."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model, _ = qp.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = qp.op8_quality_pu(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z = np.clip((qp.features(texts[r.doc_id]) - model.mean) / model.scale, -8, 8)
        f = float(np.tanh(z @ model.p[0] + model.p[1]) @ model.p[2] + model.p[3][0])
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-9 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
