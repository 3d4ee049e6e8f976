"""Stages by command line over the tables of a base folder: python -m ledgerline STAGE [--base FOLDER] ...

    ingest    pages, cities        -> meetings, ingest_errors      (exit 1 if a source failed)
    extract   meetings, entries, documents -> items, facts, published, queue
    digest    the same             -> digests
    check     the same             -> findings                     (exit 1 if one is of high severity)
    eval      gold, items, documents -> scorecards; --promote makes it the baseline (exit 1 if a field fell below it)
    metrics   the same as extract  -> a run in run_metrics; drift  (exit 1 if a metric drifted)
    review    queue                -> queue; --accept, --reject, --edit ID=TEXT, or a summary
    run       all of extract, digest, check and metrics

Tables are folders of Parquet under the base folder; `entries`, `documents`, `gold` and `decisions` may be JSON files
(`entries.json` and so on). The base folder is --base, else LEDGERLINE_BASE, else the folder the command runs in.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import facts as X
from ledgerline.operators import health, review, scoring
from ledgerline.plans import pipeline
from ledgerline.sources import isolated, registry
from ledgerline.sources.snapshots import Scorecards, Snapshots

SCHEMAS = {
    "entries": "meeting_id string, index int, title string, item_number string",
    "documents": "url string, text string, ocr_required boolean",
    "gold": "case_id string, field_type string, idx int, value string, annotated_fields array<string>",
    "decisions": "queue_id string, decision string, text string, note string",
}


def base_path(given: str | None = None) -> str:
    """--base, else the environment's LEDGERLINE_BASE, else the working folder, as a path that Spark reads."""
    path = given or os.environ.get("LEDGERLINE_BASE") or os.getcwd()
    return path.rstrip("/") if ":/" in path else os.path.abspath(path)


class Base:
    """The tables of a base folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        """A table, or the JSON file of that name; neither is an error of the stage."""
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            if name not in SCHEMAS:
                raise pipeline.StageError(f"no table {name} under {self.path}") from None
        try:
            return self.spark.read.schema(SCHEMAS[name]).option("multiLine", True).json(f"{self.path}/{name}.json")
        except AnalysisException:
            raise pipeline.StageError(f"neither {name} nor {name}.json under {self.path}") from None

    def kept(self, name: str) -> Snapshots:
        """A table that a stage replaces: readers see the version before or the one after."""
        return Snapshots(self.spark, f"{self.path}/{name}")

    def latest(self, name: str) -> DataFrame | None:
        kept = self.kept(name)
        return kept.read() if kept.version() else None


def _run(base: Base, args: argparse.Namespace) -> pipeline.Run:
    return pipeline.run(base.read("meetings"), base.read("entries"), base.read("documents"), args.run_id, args.at)


def ingest(base: Base, args: argparse.Namespace) -> int:
    cities = registry.load_registry(base.spark, args.cities or f"{base.path}/cities.yaml")
    chosen = registry.active(cities, args.connector, args.city, args.limit)
    asked = chosen.select(F.col("name").alias("source"), "connector", F.coalesce("body", F.lit(registry.C.DEFAULT_BODY)).alias("asked"), F.concat(F.regexp_replace("root_url", r"(?i)/calendar\.aspx.*$", ""), F.lit("/")).alias("base"))
    pages = base.read("pages").join(asked, "source")
    found = isolated.ingest(pages.select("page_id", "source", "connector", "asked", "base", "html"))
    base.kept("ingested").replace(found.meetings)
    base.kept("ingest_errors").replace(found.errors)
    for r in found.sources.orderBy("source").collect():
        print(f"{r.source}: {r.status}, {r.meetings} meetings on {r.pages} pages")
    print(json.dumps(found.counts))
    return int(found.counts["failed"] > 0)


def extract(base: Base, args: argparse.Namespace) -> int:
    out = _run(base, args)
    for name in ("items", "facts", "published"):
        base.kept(name).replace(getattr(out, name))
    queue = out.queue.withColumn("version", F.lit(0).cast("long"))
    before = base.latest("queue")
    if before is not None:  # what has been decided stays decided
        queue = review.upserted(queue, before.where("status != 'pending'"))
    base.kept("queue").replace(queue)
    print(f"{base.latest('items').count()} items, {base.latest('published').count()} facts published, {base.latest('queue').where(F.col('status') == 'pending').count()} to review")
    return 0


def digest(base: Base, args: argparse.Namespace) -> int:
    base.kept("digests").replace(_run(base, args).digest)
    for r in base.latest("digests").orderBy("meeting_id").collect():
        print(r.digest_markdown)
    return 0


def check(base: Base, args: argparse.Namespace) -> int:
    base.kept("findings").replace(_run(base, args).findings)
    found = base.latest("findings")
    for r in found.groupBy("rule", "severity").agg(F.count("*").alias("n")).orderBy("severity", "rule").collect():
        print(f"{r.severity} {r.rule}: {r.n}")
    return int(found.where("severity = 'high'").limit(1).count())


def evaluate(base: Base, args: argparse.Namespace) -> int:
    items = base.latest("items")
    if items is None:
        raise pipeline.StageError("extract has not run")
    card = pipeline.evaluation(base.read("gold"), items, items.select("case_id", "document_text"), args.suite)
    cards = Scorecards(base.spark, f"{base.path}/scorecards")
    cards.save(card, promote=args.promote)
    print(scoring.scorecard_text(card))
    fallen = scoring.regressions(cards.fields(args.suite, "latest"), cards.fields(args.suite, "baseline")).collect()
    for r in fallen:
        print(f"{r.field_type} fell from {r.baseline_f1:.4f} to {r.f1:.4f}")
    return int(bool(fallen))


def metrics(base: Base, args: argparse.Namespace) -> int:
    now, before = _run(base, args).metrics, base.latest("run_metrics")
    base.kept("run_metrics").replace(now if before is None else before.where(F.col("run_id") != args.run_id).unionByName(now))
    runs = health.latest(health.with_baseline(base.latest("run_metrics")))
    flags = health.drift_flags(runs).collect()
    for r in runs.collect():
        print(health.city_report(r.asDict(), [f.asDict() for f in flags if f.jurisdiction == r.jurisdiction]))
    return int(bool(flags))


def reviewed(base: Base, args: argparse.Namespace) -> int:
    queue = base.kept("queue")
    if not queue.version():
        raise pipeline.StageError("extract has not run")
    rows = [(i, "accept", None, None) for i in args.accept] + [(i, "reject", None, None) for i in args.reject] + [(*e.split("=", 1), None) for e in args.edit]
    rows = [r if len(r) == 4 else (r[0], "edit", r[1], None) for r in rows]
    if rows:
        decisions = base.spark.createDataFrame(rows, SCHEMAS["decisions"])
        queue.change(lambda now: review.upserted(now, review.decided(now, decisions).withColumn("version", F.col("version") + 1)))
    counts = review.summary(queue.read()).first().asDict()
    print(", ".join(f"{n} {k}" for k, n in counts.items()))
    return 0


def run(base: Base, args: argparse.Namespace) -> int:
    """All stages; the last exit code that is not 0 counts, what a stage found is stored before the next one."""
    return max([stage(base, args) for stage in (extract, digest, check, metrics)])


STAGES: dict[str, Callable[[Base, argparse.Namespace], int]] = {"ingest": ingest, "extract": extract, "digest": digest, "check": check, "eval": evaluate, "metrics": metrics, "review": reviewed, "run": run}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m ledgerline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stages = out.add_subparsers(dest="stage", required=True)
    for name in STAGES:
        one = stages.add_parser(name)
        one.add_argument("--base")
        one.add_argument("--run-id", default="run-1")
        one.add_argument("--at", default="1970-01-01T00:00:00Z", help="when the run was made (ISO 8601, UTC)")
        if name == "ingest":
            one.add_argument("--cities")
            one.add_argument("--connector")
            one.add_argument("--city")
            one.add_argument("--limit", type=int)
        elif name == "eval":
            one.add_argument("--suite", default="default")
            one.add_argument("--promote", action="store_true")
        elif name == "review":
            for option in ("--accept", "--reject", "--edit"):
                one.add_argument(option, action="append", default=[])
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        return STAGES[args.stage](Base(spark, base_path(args.base)), args)
    except pipeline.StageError as error:
        print(f"{args.stage}: {error}", file=sys.stderr)
        return 2
