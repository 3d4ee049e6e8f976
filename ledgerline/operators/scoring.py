"""Scores: precision and recall, calibration, derived thresholds, regression gates. Sums first, ratios last, no rounding."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.operators.facts import with_verification
from ledgerline.operators.matching import any_match, greedy_match


def ratio_or(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall, f1 beside tp, fp, fn; an empty denominator gives 1, 1 and 0."""
    p, r = ratio_or(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio_or(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    df = df.withColumns({"precision": p.cast("double"), "recall": r.cast("double")})
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))


def field_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in C.FIELD_TYPES], "field_type string")


def case_scores(matched: DataFrame) -> DataFrame:
    """tp, fp, fn and ratios per case and field of greedy_match's rows."""
    hit, gold = F.col("other").isNotNull(), F.col("side") == "gold"
    return with_prf(matched.groupBy("case_id", "field_type").agg(F.count_if(gold & hit).alias("tp"), F.count_if(~gold & ~hit).alias("fp"), F.count_if(gold & ~hit).alias("fn")))


def pooled_scores(matched: DataFrame) -> DataFrame:
    """The same over all cases, a row for each of the four fields."""
    counts = matched.groupBy("field_type").agg(
        F.count_if((F.col("side") == "gold") & F.col("other").isNotNull()).alias("tp"), F.count_if((F.col("side") == "pred") & F.col("other").isNull()).alias("fp"), F.count_if((F.col("side") == "gold") & F.col("other").isNull()).alias("fn"))
    every = field_dimension(matched.sparkSession).join(counts, "field_type", "left").na.fill(0, ["tp", "fp", "fn"])
    return with_prf(every)


def annotated_only(facts: DataFrame) -> DataFrame:
    """Facts of fields that their case lists in annotated_fields (all where it is NULL)."""
    return facts.where(F.col("annotated_fields").isNull() | F.array_contains("annotated_fields", F.col("field_type")))


def evaluate(gold: DataFrame, raw: DataFrame, filtered: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(greedy matches of the filtered facts, calibration points of the raw ones).

    gold: case_id, field_type, idx, value, annotated_fields. raw and filtered: exploded facts. documents: case_id,
    document_text. A case whose extraction failed simply has no facts, so its labels count as missed.
    """
    fields = gold.select("case_id", "annotated_fields").distinct()
    pick = lambda df: annotated_only(df.join(fields, "case_id", "left"))
    matched = greedy_match(pick(gold.drop("annotated_fields")), pick(filtered))
    checked = any_match(pick(gold.drop("annotated_fields")), with_verification(raw, documents))
    points = checked.withColumn("scored", F.lit(True)).join(fields, "case_id", "left")
    points = points.select("case_id", "field_type", "confidence", "verified", (F.col("verified") & F.col("matches")).alias("correct"), (F.col("annotated_fields").isNull() | F.array_contains("annotated_fields", F.col("field_type"))).alias("annotated"))
    return matched, points


def point_rates(points: DataFrame) -> DataFrame:
    """hallucination_rate and mean_confidence, in one pass over the points."""
    return points.agg(
        F.coalesce(F.avg(F.when(F.col("verified"), 0.0).otherwise(1.0)), F.lit(0.0)).alias("hallucination_rate"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def hallucination_rate(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.avg(F.when(F.col("verified"), 0.0).otherwise(1.0)), F.lit(0.0)).alias("hallucination_rate"))


def validity_rate(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.avg(F.col("schema_valid").cast("double")), F.lit(1.0)).alias("schema_validity_rate"))


def mean_confidence(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def bucket_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, low, high, f"[{low:.2f}, {high:.2f})") for i, (low, high) in enumerate(C.CALIBRATION_EDGES)]
    return spark.createDataFrame(rows, "bucket int, low double, high double, range_label string")


def calibration(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group and bucket: n, mean_confidence, accuracy (0 where empty), and `total`, the group's count of all points.

    points: confidence, correct. A confidence outside all buckets counts in total alone.
    """
    by = by or []
    bucket = F.lit(None).cast("int")
    for i, (low, high) in enumerate(C.CALIBRATION_EDGES):
        bucket = F.when((F.col("confidence") >= low) & (F.col("confidence") < high), F.lit(i)).otherwise(bucket)
    cells = points.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sum("confidence").alias("sum_confidence"), F.count_if("correct").alias("right"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    frame = totals.crossJoin(F.broadcast(bucket_dimension(points.sparkSession)))  # five rows for each group
    out = frame.join(cells.where("bucket IS NOT NULL"), [*by, "bucket"], "left").na.fill(0, ["n"])
    return out.select(*by, "bucket", "low", "range_label", "n", "total", F.when(F.col("n") == 0, 0.0).otherwise(F.col("sum_confidence") / F.col("n")).alias("mean_confidence"), F.when(F.col("n") == 0, 0.0).otherwise(F.col("right") / F.col("n")).alias("accuracy"))


def calibration_error(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count-weighted mean gap of confidence and accuracy, over all points of the group."""
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")
    return buckets.groupBy(*(by or [])).agg(F.coalesce(F.sum(gap) / F.nullif(F.max("total"), F.lit(0)), F.lit(0.0)).alias("ece"), F.coalesce(F.max("total"), F.lit(0)).alias("n"))


def derived_thresholds(buckets: DataFrame, by: list[str], target: float = C.TARGET_ACCURACY, least: int = C.MIN_BUCKET, fallback: float = C.FALLBACK_THRESHOLD) -> DataFrame:
    """The lower edge of the first bucket that is large and right enough, else the fallback, with the reason."""
    good = (F.col("n") >= least) & (F.col("accuracy") >= target)
    first = F.min(F.when(good, F.struct("low", "range_label", "n", "accuracy")))
    reason = F.when(F.col("first").isNotNull(), F.concat(F.lit("bucket "), F.col("first.range_label"), F.lit(" has "), F.col("first.n").cast("string"), F.lit(" points"))).otherwise("no bucket qualifies")
    return buckets.groupBy(*by).agg(first.alias("first")).select(*by, F.coalesce("first.low", F.lit(fallback)).alias("threshold"), reason.alias("reason"))


def regressions(current: DataFrame, baseline: DataFrame, margin: float = C.REGRESSION_MARGIN, keys: tuple[str, ...] = ("suite", "field_type")) -> DataFrame:
    """Fields whose f1 fell by more than the margin; fields that the baseline lacks are left out."""
    old = baseline.select(*keys, F.col("f1").alias("baseline_f1"))
    return current.join(old, list(keys)).where(F.col("baseline_f1") - F.col("f1") > margin).select(*keys, "f1", "baseline_f1", (F.col("f1") - F.col("baseline_f1")).alias("delta"))


# ---- sets of rules ------------------------------------------------------------------------------------


def rule_sets(cases: DataFrame) -> DataFrame:
    """tp, fp, fn as arrays. cases: expected, actual (arrays of rule names)."""
    return cases.withColumns({"tp_rules": F.array_intersect("expected", "actual"), "fp_rules": F.array_except("actual", "expected"), "fn_rules": F.array_except("expected", "actual")})


def _long(cases: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule_sets(cases).select(F.explode(f"{k}_rules").alias("rule"), F.lit(k).alias("kind")) for k in ("tp", "fp", "fn")])


def rule_scores(cases: DataFrame, overall: bool = False) -> DataFrame:
    """Pooled scores per rule seen on either side; with `overall`, one row over all rules."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    return with_prf(_long(cases).agg(*counts) if overall else _long(cases).groupBy("rule").agg(*counts))


def merged_rules(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """Distinct rule names of both tiers per text."""
    return findings.select("text_id", "rule").unionByName(judged.select("text_id", "rule")).groupBy("text_id").agg(F.array_sort(F.collect_set("rule")).alias("actual"))


# ---- presentation -------------------------------------------------------------------------------------


def scorecard(matched: DataFrame, points: DataFrame, items: DataFrame, suite: str = "default", digits: int = 4) -> dict:
    """The scores as a plain dict, rounded for reading; a few rows are collected."""
    show = lambda x: round(float(x), digits)
    buckets, per_field = calibration(points), calibration(points, ["field_type"])
    ece = {r.field_type: r for r in calibration_error(per_field, ["field_type"]).collect()}
    lines = lambda rows: [{"range": b.range_label, "count": b.n, "mean_confidence": show(b.mean_confidence), "accuracy": show(b.accuracy)} for b in rows]
    fields = sorted(per_field.collect(), key=lambda b: b.low)
    return {
        "suite": suite,
        "fields": {r.field_type: {"precision": show(r.precision), "recall": show(r.recall), "f1": show(r.f1), "true_positives": r.tp, "false_positives": r.fp, "false_negatives": r.fn} for r in pooled_scores(matched).collect()},
        "hallucination_rate": show(hallucination_rate(points).first()[0]),
        "schema_validity_rate": show(validity_rate(items).first()[0]),
        "mean_confidence": show(mean_confidence(points).first()[0]),
        "calibration": {"expected_calibration_error": show(next(iter(calibration_error(buckets).collect())).ece), "buckets": lines(buckets.orderBy("low").collect())},
        "calibration_by_field": {f: {"expected_calibration_error": show(r.ece), "n": r.n, "buckets": lines(b for b in fields if b.field_type == f)} for f, r in ece.items()},
    }


def baseline_path(root: str, suite: str) -> str:
    """One baseline per suite; suites are never pooled."""
    return f"{root}/baseline_{suite}.json"


def scorecard_text(card: dict) -> str:
    rows = [f"{f:<10} P {x['precision']:.4f}  R {x['recall']:.4f}  F1 {x['f1']:.4f}" for f, x in card["fields"].items()]
    return "\n".join([*rows, f"hallucination {card['hallucination_rate']:.4f}  valid {card['schema_validity_rate']:.4f}  ECE {card['calibration']['expected_calibration_error']:.4f}"])


def scorecard_json(card: dict) -> str:
    return json.dumps(card, indent=2, sort_keys=True)
