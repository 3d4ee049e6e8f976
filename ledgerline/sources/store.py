"""Tables on disk: JSON cases, meetings, queues and run histories, and the cache of model responses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ledgerline.functions.text import slug
from ledgerline.functions.urls import cache_key


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where a local session names none, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder()
    return named.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerline-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; what follows reads it from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_cases(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """Labelled cases, one JSON document per file, with their file's name; none at all is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if df.isEmpty():
        raise LookupError(f"no cases under {path}")
    return df.orderBy("file")


def read_or_empty(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_by_city(df: DataFrame, path: str, label: str | None = None, mode: str = "overwrite") -> None:
    """Partitions by city slug (and a label); only the partitions of the rows at hand are replaced."""
    df = df.withColumn("city_slug", slug(F.col("jurisdiction")))
    parts = ["city_slug", *([label] if label else [])]
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_run(metrics: DataFrame, path: str) -> None:
    metrics.withColumn("city_slug", slug(F.col("jurisdiction"), trim=True)).write.mode("append").partitionBy("city_slug").parquet(path)


def run_history(spark: SparkSession, path: str, schema: S.StructType | str, jurisdiction: str) -> DataFrame:
    """One city's runs, oldest first; only its partition is read."""
    return read_or_empty(spark, path, schema).where(F.col("city_slug") == jurisdiction.strip().lower().replace(" ", "-")).orderBy("generated_at")


def answered(requests: DataFrame, cache: DataFrame, provider: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(all requests with their response, the new cache rows). requests: prompt_version, model, request (canonical JSON).

    Stored responses are joined first; the provider is called, by partition, only for the distinct rest.
    """
    keyed = requests.withColumn("key", cache_key(F.col("prompt_version"), F.col("model"), F.col("request")))
    new = keyed.select("key", "request").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "response": [provider(r) for r in pdf["request"]]})

    made = new.mapInPandas(run, "key string, response string")
    return keyed.join(cache.select("key", "response").unionByName(made), "key", "left"), made
