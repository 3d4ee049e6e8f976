import decimal
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from ledgerline.functions import constants as C
from ledgerline.operators.health import FLOATS
from ledgerline.plans import catalogue, operator_queries
from ledgerline.streaming import facts as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = catalogue.queries()[name](spark, SF), con.execute(catalogue.oracle_sql()[name])
    names, columns = [d[0] for d in want.description], sorted(got.columns)
    assert columns == sorted(names)
    plain = lambda x: round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else list(x) if isinstance(x, (list, tuple)) else x
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert rows or name not in vars(operator_queries)  # no agreement about nothing


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    if os.path.isdir(SF):
        assert entry_points.entry(spark).columns == ["doc_id", "item_id"]


def test_streams(spark, tmp_path):
    facts = spark.createDataFrame([("c", "people", i, 0.9 + i / 20) for i in range(3)], "case_id string, field_type string, idx int, confidence double")
    facts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    streams.route_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.idx: r.route for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "queued", 1: "published", 2: "published"}
    runs = spark.createDataFrame([("sj", str(i), str(i), *[float(i)] * len(FLOATS)) for i in range(3)], "jurisdiction string, run_id string, generated_at string, " + ", ".join(f"{c} double" for c in FLOATS))
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    got = {}

    def keep(df):
        got.update({r.run_id: (r.runs, r.base_mean_confidence) for r in df.collect()})

    streams.each_batch(streams.trailing_stream(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))), keep, str(tmp_path / "cp2")).awaitTermination()
    assert got == {"0": (0, None), "1": (1, 0.0), "2": (2, 0.5)}
    timed = spark.createDataFrame([("sj", "2026-01-01", 0.5, True), ("sj", "2026-01-01", 1.0, False)], "jurisdiction string, ts string, confidence double, verified boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    row = streams.windowed_rates(timed).first()
    assert row.facts == 2 and row.hallucination_rate == 0.5 and json.dumps(row.mean_confidence) == "0.75"


def test_template_digests_send_no_texts_through_the_driver(spark, tmp_path):
    """Meetings with shown items, with closed sessions alone and without a key; no side of a join is broadcast, however small it seems."""
    orders = [(k, c, 5.0, "1-URGENT") for k, c in [(12, 1), (3, 1), (2, 1), (4, 1), (31, 2), (5, None)]]  # 12 and 3: reports, 2: action, 4 and 31: closed sessions
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    facts = {r.meeting_id: r.facts for r in operator_queries.rendered(spark, str(tmp_path)).collect()}
    block = "Item {}: 1-URGENT\n  - Person: Clerk Roe (staff)\n  - Amount: $5 (contract) = $5".format
    assert facts == {1: f"## Other Actions\n\n{block(2)}\n\n## Reports\n\n{block(3)}\n\n{block(12)}", 2: C.EMPTY_FACTS, None: C.EMPTY_FACTS}
    got = operator_queries.template_digests(spark, str(tmp_path))
    assert {r.meeting_id for r in got.collect()} == {1, 2}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_style_findings_of_all_rules(spark, tmp_path):
    long = "The council approved $5 for you of course " + "considerable administrative reorganization " * 60 + "today."
    spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.text_id, r.rule, r.severity): r.n for r in catalogue.queries()["style_findings"](spark, str(tmp_path)).collect()}
    assert rows == {("1", rule, s): n for rule, s, n in [
        ("missing_header", "high", 1), ("missing_overview", "high", 1), ("missing_citation", "high", 1), ("banned_construction", "medium", 2),
        ("paragraph_too_long", "low", 1), ("sentence_too_long", "low", 1), ("reading_level", "low", 1)]} | {("2", "section_order", "medium"): 1}


def test_style_findings_read_each_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "One."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalogue.queries()["style_findings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
