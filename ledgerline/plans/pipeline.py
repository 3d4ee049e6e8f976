"""Compositions of the operators: one meeting from end to end, ingest of many sources, evaluation of a suite."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions.text import not_empty
from ledgerline.operators import digest, health, review, scoring, style
from ledgerline.operators import facts as X
from ledgerline.sources import documents as D
from ledgerline.sources import html as H


class StageError(Exception):
    """A stage that halts a run: nothing or too much found, a scan, a missing document."""


#: (title, number, document text) -> an item as JSON. A provider may raise; the item then counts as a schema failure.
Extractor = Callable[[str, str | None, str], str]


def rule_extractor(title: str, number: str | None, text: str) -> str:
    """A deterministic stand-in without a model: tallies, movers and dollar amounts by pattern. Ours, not to be scored as a model."""
    import json
    import re

    def fact(value: dict, span: str) -> dict:
        return {"value": value, "confidence": 0.9, "provenance": {"source_document": "", "source_text": span}}

    motions = [fact({"text": title, "outcome": "passed", "votes": [], "tally": m[1]}, m[0]) for m in re.finditer(r"\((\d+(?:-\d+)+)\)", text)]
    people = [fact({"raw_name": m[0], "role": m[1].lower()}, m[0]) for m in re.finditer(r"\b(Mayor|Councilmember) [A-Z]\w+", text)]
    amounts = [fact({"raw_text": m[0], "amount_usd": m[1].replace(",", ""), "kind": "unknown"}, m[0]) for m in re.finditer(r"\$(\d[\d,]*(?:\.\d+)?)", text)]
    kind = "consent" if "consent" in title.lower() else "action"
    return json.dumps({"item_number": number, "title": title, "item_type": kind, "motions": motions, "people": people, "locations": [], "amounts": amounts})


def extracted(entries: DataFrame, documents: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """case_id and payload (JSON, NULL where the provider failed) of every titled entry.

    entries: case_id, meeting_id, title, item_number. The text stays once per document and is joined by its key.
    """
    rows = entries.where(not_empty(F.col("title")).isNotNull()).join(documents.select("meeting_id", "document_text"), "meeting_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for title, number, text in zip(pdf["title"], pdf["item_number"], pdf["document_text"]):
                try:
                    out.append(extractor(title, number, text))
                except Exception:  # one item's failure is a row, not the run's end
                    out.append(None)
            yield pd.DataFrame({"case_id": pdf["case_id"], "meeting_id": pdf["meeting_id"], "payload": out})

    return rows.select("case_id", "meeting_id", "title", "item_number", "document_text").mapInPandas(run, "case_id string, meeting_id string, payload string")


def _from(listed: Column, least: Column) -> Column:
    return F.filter(listed, lambda x: x["confidence"] >= least)


@dataclass
class Run:
    """The tables of a run; all are lazy until used."""

    items: DataFrame
    facts: DataFrame
    published: DataFrame
    queue: DataFrame
    digest: DataFrame
    findings: DataFrame
    metrics: DataFrame


def meeting_documents(meetings: DataFrame, fetched: DataFrame) -> DataFrame:
    """meeting_id, url and document_text. A meeting without a URL or whose document is a scan has a NULL text and a reason."""
    wanted = meetings.withColumn("url", D.chosen_url())
    df = wanted.join(fetched.select("url", "text", "ocr_required"), "url", "left")
    reason = F.when(F.col("url").isNull(), "no document").when(F.col("text").isNull(), "not fetched").when(F.col("ocr_required"), "needs OCR")
    return df.select("meeting_id", "url", F.when(reason.isNull(), F.col("text")).alias("document_text"), reason.alias("reason"))


def run(meetings: DataFrame, entries: DataFrame, fetched: DataFrame, run_id: str, generated_at: str, extractor: Extractor = rule_extractor, thresholds: dict[str, float] | None = None, dry_run: bool = False) -> Run | dict:
    """Meetings to digests, queue and metrics. meetings: meeting_id, jurisdiction, body, date, minutes_url, agenda_url.

    entries: meeting_id, index, title, item_number. dry_run returns the plan as text and runs nothing.
    """
    documents = meeting_documents(meetings, fetched)
    cases = entries.withColumn("case_id", F.concat_ws("-", "meeting_id", F.col("index").cast("string")))
    if not dry_run and (bad := documents.where("document_text IS NULL").first()):
        raise StageError(f"meeting {bad.meeting_id}: {bad.reason}")
    raw = X.parsed(extracted(cases, documents, extractor)).join(documents.select("meeting_id", "document_text", F.col("url").alias("source_document")), "meeting_id")
    facts = X.routed(X.with_verification(X.exploded(raw.where("schema_valid")), raw.select("case_id", "document_text")), thresholds)
    if dry_run:
        return {"meetings": "resolved lazily", "plan": facts._jdf.queryExecution().simpleString()}
    published = facts.where("verified AND route = 'published'")
    context = raw.select("case_id", "document_text", "meeting_id").join(meetings.select("meeting_id", "jurisdiction", "body", "date"), "meeting_id")
    queue = review.queue_items(facts.where("verified"), context)
    kept = raw.where("schema_valid").withColumn("pos", F.element_at(F.split("case_id", "-"), -1).cast("int"))
    shown = X.drop_unverified(kept)
    for field in C.FIELD_TYPES:  # only published facts reach the digest
        least = X.threshold(F.lit(field), thresholds)
        shown = shown.withColumn("item", F.col("item").withField(field, _from(F.col(f"item.{field}"), least)))
    text = digest.template_digest(digest.rendered_facts(shown), meetings)
    rules = style.context_of(shown.select(F.col("meeting_id").alias("text_id"), "pos", F.col("item.item_number").alias("item_number"), F.transform("item.people", lambda x: x["value"]).alias("people")))
    findings = style.check_deterministic(text.select(F.col("meeting_id").alias("text_id"), F.col("digest_markdown").alias("text")).join(rules, "text_id", "left"))
    counts = published.groupBy("case_id").pivot("field_type", C.FIELD_TYPES).agg(F.count(F.lit(1))).na.fill(0)
    items = raw.join(counts, "case_id", "left").na.fill(0, C.FIELD_TYPES).join(meetings.select("meeting_id", "jurisdiction"), "meeting_id")
    named = items.select(F.lit(run_id).alias("run_id"), "jurisdiction", F.lit(generated_at).alias("generated_at"), "schema_valid", *[F.col(f).alias(f"n_{f}") for f in C.FIELD_TYPES])
    metrics = health.run_metrics(named, facts.withColumn("run_id", F.lit(run_id)))
    return Run(raw, facts, published, queue, text, findings, metrics)


def ingest(pages: DataFrame, cities: DataFrame, period: str, fallback: str, limit: int = 5) -> DataFrame:
    """Meetings of all cities from landed pages (jurisdiction, period, html), with the fallback period where the first has no details.

    Cities are rows, so one that fails to parse has no meetings and stops no other.
    """
    parsed = H.parsed_pages(pages.join(cities.select(F.col("name").alias("jurisdiction"), "connector", F.coalesce("body", F.lit(C.DEFAULT_BODY)).alias("asked"), "root_url"), "jurisdiction"))
    keys = ("jurisdiction", "period")
    root = F.concat(F.regexp_replace("root_url", r"(?i)/calendar\.aspx.*$", ""), F.lit("/"))
    grids = H.calendar_meetings(parsed.where("connector = 'legistar'"), F.col("asked"), root, limit, keys)
    centers = H.agenda_center_meetings(parsed.where("connector = 'civicplus'"), F.col("asked"), F.col("root_url"), limit, keys)
    return D.with_fallback_period(grids.unionByName(centers), period, fallback)


def city_status(cities: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per city how many meetings were found, and a status."""
    n = meetings.groupBy("jurisdiction").agg(F.count("*").alias("meetings"))
    df = cities.select(F.col("name").alias("jurisdiction")).join(n, "jurisdiction", "left").na.fill(0, ["meetings"])
    return df.withColumn("status", F.when(F.col("meetings") > 0, "ok").otherwise("empty"))


def evaluation(gold: DataFrame, items: DataFrame, documents: DataFrame, suite: str = "default") -> dict:
    """The scorecard of extracted items against labelled cases."""
    valid = items.where("schema_valid")
    raw = X.exploded(valid)
    filtered = X.with_verification(raw, documents).where("verified")
    matched, points = scoring.evaluate(gold, raw, filtered, documents)
    return scoring.scorecard(matched, points, items, suite)
