"""Run metrics per source, trailing baselines, drift flags and their reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions.text import slug

RATES = [f"rate_{f}" for f in C.FIELD_TYPES]
FLOATS = ["schema_failure_rate", *RATES, "mean_confidence", "hallucination_rate"]
INTEGERS = ["rows_parsed", "schema_failures", "review_queue_volume"]


def run_metrics(items: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per run.

    items: run_id, jurisdiction, generated_at, schema_valid, and per field n_<field> (published facts of the item).
    facts: run_id, confidence, verified, route (raw facts; route 'queued' counts as review volume).
    Rates of populated fields are over valid items, confidence and hallucination over raw facts.
    """
    valid = F.col("schema_valid")
    by_items = items.groupBy("run_id", "jurisdiction", "generated_at").agg(
        F.count("*").alias("rows_parsed"), F.count_if(~valid).alias("schema_failures"), F.coalesce(F.avg((~valid).cast("double")), F.lit(0.0)).alias("schema_failure_rate"),
        *[F.coalesce(F.avg(F.when(valid, (F.col(f"n_{f}") > 0).cast("double"))), F.lit(0.0)).alias(f"rate_{f}") for f in C.FIELD_TYPES],
    )
    by_facts = facts.groupBy("run_id").agg(
        F.avg("confidence").alias("mean_confidence"), F.avg(F.when(F.col("verified"), 0.0).otherwise(1.0)).alias("hallucination_rate"), F.count_if((F.col("route") == "queued") & F.col("verified")).alias("review_queue_volume"))
    return by_items.join(by_facts, "run_id", "left").na.fill(0.0, ["mean_confidence", "hallucination_rate"]).na.fill(0, ["review_queue_volume"])


def city_slug(name: Column) -> Column:
    return slug(name, trim=True)


def with_baseline(history: DataFrame) -> DataFrame:
    """Every run beside the means over all earlier runs of its city (base_...), NULL for the first. Runs of one time go by id.

    Missing rates count as 0; means of whole numbers are rounded half to even.
    """
    earlier = Window.partitionBy(city_slug(F.col("jurisdiction"))).orderBy("generated_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    means = {f"base_{c}": F.avg(F.coalesce(c, F.lit(0.0))).over(earlier) for c in FLOATS}
    means |= {f"base_{c}": F.bround(F.avg(c).over(earlier), 0).cast("long") for c in INTEGERS}
    return history.withColumns(means)


def latest(history: DataFrame) -> DataFrame:
    last = Window.partitionBy(city_slug(F.col("jurisdiction"))).orderBy(F.col("generated_at").desc(), F.col("run_id").desc())
    return history.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def drift_flags(runs: DataFrame) -> DataFrame:
    """run_id, jurisdiction, metric, baseline, current, delta, message of every metric that moved too far. runs: with_baseline's rows."""
    n = len(FLOATS)
    stacked = ", ".join(f"'{c}', base_{c}, CAST({c} AS DOUBLE)" for c in FLOATS)
    long = runs.selectExpr("run_id", "jurisdiction", f"stack({n}, {stacked}) AS (metric, baseline, current)").where("baseline IS NOT NULL")
    delta = F.col("current") - F.col("baseline")
    moved = (
        F.when(F.col("metric") == "schema_failure_rate", delta > C.DRIFT_SCHEMA_RISE)
        .when(F.col("metric") == "mean_confidence", -delta > C.DRIFT_CONFIDENCE_DROP)
        .when(F.col("metric") == "hallucination_rate", delta > C.DRIFT_HALLUCINATION_RISE)
        .otherwise(F.abs(delta) > C.DRIFT_POPULATION_SHIFT)
    )
    message = F.format_string("%s moved from %.3f to %.3f", "metric", "baseline", "current")
    return long.where(moved).select("run_id", "jurisdiction", "metric", "baseline", "current", delta.alias("delta"), message.alias("message"))


def city_report(run: dict, flags: Iterable[dict]) -> str:
    """Markdown of one run's health."""
    flags = list(flags)
    lines = [f"# Run health: {run['jurisdiction']}", "", f"Run {run['run_id']} of {run['generated_at']}", "", "| metric | baseline | current |", "| --- | --- | --- |"]
    for c in [*INTEGERS, *FLOATS]:
        base = run.get(f"base_{c}")
        lines.append(f"| {c} | {'-' if base is None else format(base, '.3f') if c in FLOATS else base} | {format(run[c], '.3f') if c in FLOATS else run[c]} |")
    lines += ["", "## Drift", "", *([f"- {f['message']}" for f in flags] or ["No drift."])]
    return "\n".join(lines)


def fleet_summary(runs: DataFrame, flags: DataFrame) -> DataFrame:
    """cities, flags in all, and the flagged cities in order."""
    per = flags.groupBy("jurisdiction").agg(F.count("*").alias("n"))
    one = runs.select("jurisdiction").distinct().join(per, "jurisdiction", "left")
    return one.agg(F.count("*").alias("cities"), F.coalesce(F.sum("n"), F.lit(0)).alias("flags"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("jurisdiction")))), ", ").alias("flagged"))


def fleet_report(summary: dict) -> str:
    return f"# Fleet health\n\n{summary['cities']} cities, {summary['flags']} flags.\n\nFlagged: {summary['flagged'] or 'none'}"


def without_fields(items: DataFrame, fields: list[str]) -> DataFrame:
    """Items as a broken source would give them: no facts of these fields."""
    return items.withColumns({f"n_{f}": F.lit(0) for f in fields})
