"""Ratcliff-Obershelp likeness of texts; Spark has no such expression, so an Arrow-batched kernel computes it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.functions.text import normalize


def ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Likeness of the normalised texts, a first (the measure is not symmetric); two missing texts are alike."""
    return _ratio(normalize(a), normalize(b))


def at_least(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) >= least, computed only where the lengths allow it (twice the shorter over the sum bounds it)."""
    x, y = F.char_length(normalize(a)), F.char_length(normalize(b))
    possible = (x + y == 0) | (2.0 * F.least(x, y) >= least * (x + y))
    return possible & (similarity(a, b) >= least)
