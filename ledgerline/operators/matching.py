"""Matching of predicted to labelled facts: matchers, greedy one-to-one claims, any-match."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions import text as T
from ledgerline.functions.similarity import ratio


def strip_title(name: Column) -> Column:
    """The normalised name without one leading title."""
    return F.regexp_replace(T.normalize(name), "^(" + "|".join(C.PERSON_TITLES) + ") ", "")


def amounts_equal(a: Column, b: Column) -> Column:
    """Within the tolerance as numbers; false where either is no number."""
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < C.AMOUNT_TOLERANCE, F.lit(False))


# ---- the same predicates on dicts, for the grouped kernels; each takes the label first ----


def _plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _alike(a: str | None, b: str | None, least: float) -> bool:
    a, b = _plain(a), _plain(b)
    if a == b:
        return True
    return 2.0 * min(len(a), len(b)) >= least * (len(a) + len(b)) and ratio(a, b) >= least


def match_motion(gold: dict, pred: dict, least: float = C.MOTION_TEXT) -> bool:
    if gold.get("outcome") != pred.get("outcome"):
        return False
    tallies = gold.get("tally"), pred.get("tally")
    return bool(all(tallies) and _plain(tallies[0]) == _plain(tallies[1])) or _alike(gold.get("text"), pred.get("text"), least)


def _untitled(name: str | None) -> str:
    plain = _plain(name)
    return next((plain[len(t) + 1 :] for t in C.PERSON_TITLES if plain.startswith(t + " ")), plain)


def match_person(gold: dict, pred: dict, least: float = C.PERSON_NAME) -> bool:
    return _alike(_untitled(gold.get("raw_name")), _untitled(pred.get("raw_name")), least)


def match_location(gold: dict, pred: dict, least: float = C.LOCATION_TEXT) -> bool:
    return _alike(gold.get("raw_text"), pred.get("raw_text"), least)


def match_amount(gold: dict, pred: dict, least: float = C.AMOUNT_TEXT) -> bool:
    a, b = gold.get("amount_usd"), pred.get("amount_usd")
    if a is None or b is None:
        return _alike(gold.get("raw_text"), pred.get("raw_text"), least)
    try:
        return abs(float(a) - float(b)) < C.AMOUNT_TOLERANCE
    except (TypeError, ValueError):
        return False


MATCHERS: dict[str, Callable[[dict, dict], bool]] = {"motions": match_motion, "people": match_person, "locations": match_location, "amounts": match_amount}


def claims(gold: list[dict], pred: list[dict], match: Callable[[dict, dict], bool]) -> list[tuple[int, int]]:
    """Every label, in order, takes the first prediction that matches and is still free."""
    free = dict.fromkeys(range(len(pred)))
    pairs = []
    for g, label in enumerate(gold):
        taken = next((p for p in free if match(label, pred[p])), None)
        if taken is not None:
            del free[taken]
            pairs.append((g, taken))
    return pairs


PAIRED = "case_id string, field_type string, side string, idx int, other int"


def greedy_match(gold: DataFrame, predicted: DataFrame, matchers: dict | None = None) -> DataFrame:
    """Every label and prediction with the index it is paired with (`other`, NULL where it has none).

    Both sides: case_id, field_type, idx, value (JSON). A case's facts of one field are one document's, so a group is small;
    it is gathered to one row, and tasks take many such rows at a time.
    """
    import json

    matchers = matchers or MATCHERS
    names = [f.split()[0] for f in PAIRED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case, field, gold, pred in zip(*(batch.column(c).to_pylist() for c in ("case_id", "field_type", "gold", "pred"))):
                pairs = claims([json.loads(x["value"]) for x in gold], [json.loads(x["value"]) for x in pred], matchers[field])
                by_gold, by_pred = dict(pairs), {p: g for g, p in pairs}
                rows += [(case, field, "gold", x["idx"], pred[by_gold[k]]["idx"] if k in by_gold else None) for k, x in enumerate(gold)]
                rows += [(case, field, "pred", x["idx"], gold[by_pred[k]]["idx"] if k in by_pred else None) for k, x in enumerate(pred)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    def of(side: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("idx", "value")))).alias(side)

    case, idx = F.col("case_id").cast("string").alias("case_id"), F.col("idx").cast("int").alias("idx")
    both = gold.select(case, "field_type", F.lit("gold").alias("side"), idx, "value").unionByName(predicted.select(case, "field_type", F.lit("pred").alias("side"), idx, "value"))
    return both.groupBy("case_id", "field_type").agg(of("gold"), of("pred")).mapInArrow(run, PAIRED)


def greedy_fold(matrix: Column) -> Column:
    """The same claims as a native fold over a matrix of booleans: per label the prediction's place, -1 where none."""
    labels, none = F.size(matrix), F.expr("cast(array() as array<int>)")

    def take(acc: Column, i: Column) -> Column:
        row = F.get(matrix, i)
        free = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda j: F.coalesce(F.get(row, j), F.lit(False)) & ~F.array_contains(acc, j))
        return F.array_append(acc, F.when(F.size(row) > 0, F.coalesce(F.get(free, F.lit(0)), F.lit(-1))).otherwise(-1))

    return F.when(labels > 0, F.aggregate(F.sequence(F.lit(0), labels - 1), none, take)).otherwise(none)


def any_match(gold: DataFrame, predicted: DataFrame, matchers: dict | None = None) -> DataFrame:
    """predicted with `matches`: whether any label of its case and field matches it, claimed or not."""
    import json

    matchers = matchers or MATCHERS
    labels = gold.groupBy("case_id", "field_type").agg(F.collect_list("value").alias("labels"))
    rows = predicted.join(labels, ["case_id", "field_type"], "left")
    schema = rows.drop("labels").schema.add("matches", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = [any(matchers[f](json.loads(g), json.loads(v)) for g in ([] if ls is None else ls)) for f, v, ls in zip(pdf["field_type"], pdf["value"], pdf["labels"])]
            yield pdf.drop(columns="labels").assign(matches=hit)

    return rows.mapInPandas(run, schema)
