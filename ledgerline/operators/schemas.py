"""Schemas as tables of paths, and what differs between two of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

PATHS = "path string, type string, optional boolean"


def paths(schema: S.DataType, at: str = "", optional: bool = False) -> Iterator[tuple[str, str, bool]]:
    """(path, type, whether it may be missing) of every field, nested ones too: `a.b` is a field, `a[]` what a list holds, `a{}` a map's values."""
    if isinstance(schema, S.StructType):
        if at:
            yield at, "struct", optional
        for f in schema.fields:
            yield from paths(f.dataType, f"{at}.{f.name}" if at else f.name, f.nullable)
    elif isinstance(schema, S.ArrayType):
        yield at, "list", optional
        yield from paths(schema.elementType, f"{at}[]", schema.containsNull)
    elif isinstance(schema, S.MapType):
        yield at, f"map of {schema.keyType.simpleString()}", optional
        yield from paths(schema.valueType, f"{at}{{}}", schema.valueContainsNull)
    else:
        yield at, schema.simpleString(), optional


def as_table(spark: SparkSession, schema: S.StructType) -> DataFrame:
    return spark.createDataFrame(list(paths(schema)), PATHS)


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, retyped, optional, required), old_type, new_type; paths that are alike have no row.

    A field below one that was added or removed is listed itself; a field whose type changed is retyped whatever its
    optionality.
    """
    o, n = old.select("path", F.col("type").alias("old_type"), F.col("optional").alias("was")), new.select("path", F.col("type").alias("new_type"), F.col("optional").alias("now"))
    change = (
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped").when(F.col("now") & ~F.col("was"), "optional").when(F.col("was") & ~F.col("now"), "required")
    )
    return o.join(n, "path", "full").withColumn("change", change).where("change IS NOT NULL").select("path", "change", "old_type", "new_type")


def check_document(spark: SparkSession, stored: str, schema: S.StructType) -> list[str]:
    """The lines of difference between a stored schema (JSON, as `schema.json()` writes it) and the one in use; empty: no drift."""
    rows = differences(as_table(spark, S.StructType.fromJson(json.loads(stored))), as_table(spark, schema)).orderBy("path").collect()
    return [f"{r.change}: {r.path} ({' -> '.join(filter(None, (r.old_type, r.new_type)))})" for r in rows]
