import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.operators import digest, health, matching, review, scoring
from ledgerline.operators import facts as X
from ledgerline.plans import operator_queries, pipeline

DOC = "Mayor Mahan moved. The plan passed (11-0). It costs $1,000,000."


def item(title="Plan", kind="action", people=(), amounts=(), motions=()):
    fact = lambda v, conf, span: {"value": v, "confidence": conf, "provenance": {"source_document": "d", "source_text": span}}
    return json.dumps({"item_number": "1.1", "title": title, "item_type": kind, "motions": [fact(*m) for m in motions], "people": [fact(*p) for p in people], "locations": [], "amounts": [fact(*a) for a in amounts]})


MAHAN = {"raw_name": "Mayor Mahan", "role": "mayor"}


def parsed(spark, *payloads):
    rows = [(f"c{i}", p, DOC, "doc.pdf") for i, p in enumerate(payloads)]
    return X.parsed(spark.createDataFrame(rows, "case_id string, payload string, document_text string, source_document string"))


def test_validation(spark):
    bad_role = item(people=[({"raw_name": "x", "role": "king"}, 0.9, "Mayor")])
    no_conf = item(people=[(MAHAN, None, "Mayor")])
    bad_money = item(amounts=[({"raw_text": "$1", "amount_usd": "one", "kind": "fee"}, 0.9, "$1")])
    good = item(people=[(MAHAN, 0.97, "Mayor Mahan")], amounts=[({"raw_text": "$1", "amount_usd": "1.00", "kind": "fee"}, 0.9, "$1")])
    rows = parsed(spark, good, bad_role, no_conf, bad_money, item(kind="party"), "{broken", None, "{}").select("schema_valid").collect()
    assert [r[0] for r in rows] == [True] + [False] * 7


def test_verification_and_routing(spark):
    items = parsed(spark, item(people=[(MAHAN, 0.97, "Mayor Mahan"), (MAHAN, 0.6, "Mayor"), (MAHAN, 0.99, "Never said")], amounts=[({"raw_text": "$1", "kind": "fee"}, 0.8, "$1,000,000")]), item())
    facts = X.routed(X.with_verification(X.exploded(items), items)).orderBy("field_type", "idx").collect()
    assert [(f.field_type, f.idx, f.verified, f.route, f.queue_id) for f in facts] == [
        ("amounts", 0, True, "queued", "c0-amounts-0"), ("people", 0, True, "published", "c0-people-0"), ("people", 1, True, "queued", "c0-people-1"), ("people", 2, False, "published", "c0-people-2")]
    lower = X.routed(X.exploded(items), {"people": 0.5}).where("field_type = 'people' AND idx = 1").first()
    assert lower.route == "published"
    kept = X.drop_unverified(items).orderBy("case_id").collect()
    assert [len(k.item.people) for k in kept] == [2, 0] and kept[0].item.people[0].provenance.source_document == "doc.pdf"
    assert X.schema_document()[0].startswith("- `item_number`") and X.tool_definition("t")["input_schema"]["properties"]["people"]["type"] == "array"


def test_matchers():
    assert not matching.match_motion({"outcome": "passed", "text": "a", "tally": "5-0"}, {"outcome": "failed", "text": "a", "tally": "5-0"})
    assert matching.match_motion({"outcome": "passed", "text": "abc", "tally": "5-0"}, {"outcome": "passed", "text": "xyz", "tally": "5-0 "})
    assert matching.match_person({"raw_name": "Mahan"}, {"raw_name": "Mayor Mahan"}) and not matching.match_person({"raw_name": "Mayor Mahan"}, {"raw_name": "Mayor Doan"})
    assert matching.match_amount({"raw_text": "x", "amount_usd": "1000000"}, {"raw_text": "y", "amount_usd": "1000000"})
    assert not matching.match_amount({"raw_text": "$1,000,000", "amount_usd": "1000000"}, {"raw_text": "$1,000,000", "amount_usd": "2000000"})
    assert not matching.match_amount({"amount_usd": "x"}, {"amount_usd": "1"}) and matching.match_location({}, {})
    assert matching.claims([1, 1], [1], lambda a, b: a == b) == [(0, 0)]


def test_greedy_fold_equals_claims(spark):
    rng = random.Random(1)
    matrices = [[[rng.random() < 0.4 for _ in range(p)] for _ in range(g)] for g in range(4) for p in range(4)] + [[[True, True], [True, False]]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(matrices)], "i int, m array<array<boolean>>")
    for r in df.select("i", matching.greedy_fold(F.col("m")).alias("f")).collect():
        m = matrices[r.i]
        want = dict(matching.claims(list(range(len(m))), list(range(len(m[0]) if m else 0)), lambda g, p: m[g][p]))
        assert list(r.f) == [want.get(g, -1) for g in range(len(m))]


def test_scores_and_conventions(spark):
    schema = "case_id string, field_type string, side string, idx int, other int"
    matched = spark.createDataFrame([("a", "people", "gold", 0, 0), ("a", "people", "pred", 0, 0), ("a", "people", "gold", 1, None), ("b", "amounts", "pred", 0, None), ("b", "motions", "gold", 0, None)], schema)
    rows = {r.field_type: r for r in scoring.pooled_scores(matched).collect()}
    assert len(rows) == 4 and (rows["people"].tp, rows["people"].fp, rows["people"].fn) == (1, 0, 1)
    assert (rows["locations"].precision, rows["locations"].recall, rows["locations"].f1) == (1, 1, 1)
    assert (rows["amounts"].precision, rows["amounts"].recall, rows["amounts"].f1) == (0, 1, 0)
    assert (rows["motions"].precision, rows["motions"].recall, rows["motions"].f1) == (1, 0, 0)


def test_published_counts_replay(spark):
    counts = [("motions", 33, 7, 3, 0.825, 0.9167, 0.8684), ("people", 75, 33, 1, 0.6944, 0.9868, 0.8152), ("locations", 16, 13, 1, 0.5517, 0.9412, 0.6957), ("amounts", 23, 7, 0, 0.7667, 1.0, 0.8679)]
    df = scoring.with_prf(spark.createDataFrame([c[:4] for c in counts], "field string, tp long, fp long, fn long"))
    assert {(r.field, round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) for r in df.collect()} == {(c[0], *c[4:]) for c in counts}


def test_calibration(spark):
    points = [(0.9, i < 9) for i in range(10)] + [(0.97, i < 5) for i in range(10)] + [(1.5, True)]
    buckets = scoring.calibration(spark.createDataFrame(points, "confidence double, correct boolean"))
    rows = buckets.orderBy("low").collect()
    assert [r.n for r in rows] == [0, 0, 0, 10, 10] and rows[0].accuracy == 0.0 and rows[0].total == 21 and rows[4].range_label == "[0.95, 1.01)"
    assert abs(scoring.calibration_error(buckets).first().ece - 0.47 * 10 / 21) < 1e-9
    assert scoring.calibration_error(scoring.calibration(spark.createDataFrame([], "confidence double, correct boolean"))).first().ece == 0.0
    shape = "field string, low double, range_label string, n int, accuracy double"
    stored = spark.createDataFrame([("a", 0.7, "x", 20, 0.6), ("a", 0.85, "y", 21, 0.95), ("a", 0.95, "z", 18, 0.89), ("b", 0.5, "x", 9, 1.0)], shape)
    assert {r.field: r.threshold for r in scoring.derived_thresholds(stored, ["field"]).collect()} == {"a": 0.85, "b": 0.9}


def test_rule_scores_and_gate(spark):
    cases = spark.createDataFrame([(["a", "b"], ["a", "c"])], "expected array<string>, actual array<string>")
    total = scoring.rule_scores(cases, overall=True).first()
    assert (total.tp, total.fp, total.fn) == (1, 1, 1)
    now = spark.createDataFrame([("s", "people", 0.80), ("s", "amounts", 0.80), ("s", "new", 0.1)], "suite string, field_type string, f1 double")
    old = spark.createDataFrame([("s", "people", 0.835), ("s", "amounts", 0.82)], "suite string, field_type string, f1 double")
    assert [r.field_type for r in scoring.regressions(now, old).collect()] == ["people"]


def test_drift(spark):
    base = dict(jurisdiction="San Jose", rows_parsed=8, schema_failures=2, schema_failure_rate=0.02, rate_motions=0.8, rate_people=1.0, rate_locations=0.5, rate_amounts=0.25, mean_confidence=0.9, hallucination_rate=0.0, review_queue_volume=3)
    worse = {**base, "schema_failures": 3, "rate_people": 0.0, "rate_amounts": 0.0, "mean_confidence": 0.7, "hallucination_rate": 0.2, "schema_failure_rate": 0.5, "rate_motions": 0.75}
    df = spark.createDataFrame([Row(run_id="1", generated_at="2026-01-01", **base), Row(run_id="2", generated_at="2026-01-02", **{**base, "schema_failures": 3}), Row(run_id="3", generated_at="2026-01-03", **worse)])
    runs = health.with_baseline(df)
    rows = {r.run_id: r for r in runs.collect()}
    assert rows["1"].base_mean_confidence is None and rows["3"].base_schema_failures == 2  # 2.5 to even
    flags = {(r.run_id, r.metric): r.delta for r in health.drift_flags(runs).collect()}
    assert {m for r, m in flags if r == "3"} == {"schema_failure_rate", "rate_people", "mean_confidence", "hallucination_rate"} and all(r == "3" for r, _ in flags)
    assert flags["3", "mean_confidence"] < 0 and health.latest(df).first().run_id == "3"
    report = health.city_report(rows["3"].asDict(), [r.asDict() for r in health.drift_flags(runs).collect()])
    assert "rate_people" in report and "No drift" in health.city_report(rows["1"].asDict(), [])
    fleet = health.fleet_summary(df, health.drift_flags(runs)).first().asDict()
    assert fleet == {"cities": 1, "flags": 4, "flagged": "San Jose"} and "4 flags" in health.fleet_report(fleet)


def test_run_metrics(spark):
    shape = "run_id string, jurisdiction string, generated_at string, schema_valid boolean, n_motions int, n_people int, n_locations int, n_amounts int"
    items = spark.createDataFrame([("r", "c", "t", True, 0, 2, 0, 0), ("r", "c", "t", True, 0, 0, 0, 1), ("f", "c", "t", False, 0, 0, 0, 0)], shape)
    facts = spark.createDataFrame([("r", 0.9, True, "published"), ("r", 0.7, False, "queued")], "run_id string, confidence double, verified boolean, route string")
    rows = {r.run_id: r for r in health.run_metrics(items, facts).collect()}
    assert rows["r"].rate_people == 0.5 and rows["r"].mean_confidence == 0.8 and rows["r"].hallucination_rate == 0.5 and rows["r"].review_queue_volume == 0
    assert rows["f"].schema_failure_rate == 1.0 and rows["f"].mean_confidence == 0.0 and rows["f"].rows_parsed == 1


def test_review(spark):
    shape = "queue_id string, field_type string, value string, status string, resolved_value string, reviewer_notes string, version int, source_text string, source_document string, document_text string"
    q = spark.createDataFrame([(f"q{i}", "people", json.dumps(MAHAN), "pending", None, None, 0, "s", "d", "t") for i in range(4)], shape)
    d = spark.createDataFrame([("q0", "accept", None, None), ("q1", "edit", "Matt Mahan", None), ("q2", "reject", None, "wrong"), ("q3", "skip", None, None)], "queue_id string, decision string, text string, note string")
    changed = review.decided(q, d)
    stored = review.upserted(q, changed.withColumn("version", F.lit(1)))
    rows = {r.queue_id: r for r in stored.collect()}
    assert [rows[f"q{i}"].status for i in range(4)] == ["accepted", "edited", "rejected", "pending"] and len(rows) == 4
    assert json.loads(rows["q1"].resolved_value) == {"raw_name": "Matt Mahan", "role": "mayor"} and rows["q2"].reviewer_notes == "wrong"
    assert review.summary(stored).first().asDict() == {"pending": 1, "accepted": 1, "edited": 1, "rejected": 1, "total": 4}
    assert review.session_tally(q, d).first().asDict() == {"accepted": 1, "edited": 1, "rejected": 1, "skipped": 1}
    gold = {r.case_id: r for r in review.gold_cases(stored, strict=False).collect()}
    assert set(gold) == {"review-q0", "review-q1"} and gold["review-q1"].annotated_fields == ["people"] and "person" in gold["review-q0"].notes
    with pytest.raises(Exception, match="not accepted"):
        review.gold_cases(stored).collect()


def test_run_end_to_end(spark):
    meetings = spark.createDataFrame([("m1", "San Jose", "City Council", "1/9/2026", "", "http://a/agenda.pdf")], "meeting_id string, jurisdiction string, body string, date string, minutes_url string, agenda_url string")
    entries = spark.createDataFrame([("m1", 0, "Consent Plan", "2.1"), ("m1", 1, None, "2.2"), ("m1", 2, "Boom", "2.3")], "meeting_id string, index int, title string, item_number string")
    fetched = spark.createDataFrame([("http://a/agenda.pdf", DOC, False)], "url string, text string, ocr_required boolean")

    def extractor(title, number, text):
        if title == "Boom":
            raise ValueError
        return pipeline.rule_extractor(title, number, text)

    run = pipeline.run(meetings, entries, fetched, "r1", "2026-01-10T00:00:00Z", extractor, {"people": 0.95})
    text = run.digest.first().digest_markdown
    assert "## Consent Calendar" in text and "tally 11-0" in text and "$1,000,000 (unknown) = $1000000" in text and "Person" not in text
    m = run.metrics.first()
    assert (m.rows_parsed, m.schema_failures, m.review_queue_volume, m.hallucination_rate) == (2, 1, 1, 0.0)
    assert run.queue.first().queue_id == "m1-0-people-0" and run.findings.count() >= 0
    assert "plan" in pipeline.run(meetings, entries, fetched, "r", "t", extractor, dry_run=True)
    with pytest.raises(pipeline.StageError):
        pipeline.run(meetings, entries, fetched.withColumn("ocr_required", F.lit(True)), "r", "t")
    empty = digest.rendered_facts(spark.createDataFrame([], "meeting_id string, pos int").join(run.items.select("item").limit(0)))
    assert empty.count() == 0


def test_evaluation(spark):
    items = parsed(spark, item(people=[(MAHAN, 0.97, "Mayor Mahan")]), item(people=[({"raw_name": "Ghost", "role": "staff"}, 0.8, "nobody")]))
    docs = items.select("case_id", "document_text")
    gold = spark.createDataFrame([("c0", "people", 0, json.dumps({"raw_name": "Mahan"}), None), ("c1", "people", 0, json.dumps({"raw_name": "Doan"}), ["people"])], "case_id string, field_type string, idx int, value string, annotated_fields array<string>")
    card = pipeline.evaluation(gold, items, docs)
    assert card["fields"]["people"]["true_positives"] == 1 and card["fields"]["people"]["false_negatives"] == 1 and card["fields"]["people"]["false_positives"] == 0
    assert card["hallucination_rate"] == 0.5 and "people" in scoring.scorecard_text(card) and json.loads(scoring.scorecard_json(card))
    assert scoring.baseline_path("r", "a") != scoring.baseline_path("r", "b") and len(C.FIELD_TYPES) == 4


def test_a_payload_is_parsed_once(spark):
    items = parsed(spark, item(people=[(MAHAN, 0.97, "Mayor Mahan"), (MAHAN, 0.5, "nobody")], amounts=[({"raw_text": "$1", "kind": "contract"}, 0.8, "$1")]))
    found = X.exploded(items.where("schema_valid"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((r.field_type, r.idx, r.confidence) for r in found.collect()) == [("amounts", 0, 0.8), ("people", 0, 0.97), ("people", 1, 0.5)]


def test_groups_of_matches_share_batches(spark):
    many = spark.range(3000).selectExpr("CAST(id % 1000 AS string) AS case_id", "'amounts' AS field_type", "CAST(id AS int) AS idx", "to_json(struct(id AS amount_usd)) AS value")
    matched = matching.greedy_match(many, many.where("idx % 3 = 0"))
    assert "FlatMapGroups" not in matched._jdf.queryExecution().optimizedPlan().toString()
    rows = matched.collect()
    assert len(rows) == 4000 and all(r.other == (r.idx if r.idx % 3 == 0 else None) for r in rows)


def test_rates_of_points_take_one_pass(spark):
    points = spark.createDataFrame([(True, 0.5), (False, 1.0)], "verified boolean, confidence double")
    assert scoring.point_rates(points).collect() == [(0.5, 0.75)] and scoring.point_rates(points.limit(0)).collect() == [(0.0, 0.0)]
    if os.path.isdir("/root/testdata/sf0.001"):
        rates = operator_queries.raw_rates(spark, "/root/testdata/sf0.001")
        assert rates._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_queue_and_verification_parse_payloads_once(spark, tmp_path):
    rows = [(k, 7, 1000.5, "1-URGENT") for k in (4, 4, 5, 6, 10)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    of = lambda name: getattr(operator_queries, name)(spark, str(tmp_path))
    for name, joins in {"verified_facts": 0, "queue_rows": 0, "decided_items": 1, "session_counts": 1, "reviewed_cases": 1, "rejected_items": 1}.items():
        plan = of(name)._jdf.queryExecution().optimizedPlan().toString()
        assert (name, plan.count("from_json(StructField(item_number"), plan.count("Join ")) == (name, 1, joins)
    assert of("verified_facts").count() == 10  # an order that stands twice has its facts twice, not four times
    assert sorted(r.queue_id for r in of("rejected_items").collect()) == ["o10-amounts-0", "o6-amounts-0"]
