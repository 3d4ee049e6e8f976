"""Tables that are replaced as a whole or that grow by key, on any file system that Spark writes to.

`Snapshots` keeps versions: data goes to a folder of its own, then a small file named by the version's number is created,
which fails if it is there already. So readers see the old version or the new one, a failure half-way leaves the old one,
and of two writers that started from the same version one gets `Conflict`.

`KeyedStore` grows by batches: a batch is seen once Spark has committed it, and of rows with one key the one of the first
committed batch is read, so appends may be repeated (a task, a job, two runs side by side) and leave one row a key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.urls import cache_key
from ledgerline.sources import registry


class Conflict(Exception):
    """Somebody else has replaced the version that this change started from."""


class Files:
    """The few operations on names and small files that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Writes a file that is not there yet; False if it is."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as error:  # the file system's own exception, by way of the gateway
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root.rstrip("/"))

    def _current(self) -> tuple[int, dict | None]:
        for name in reversed(self.files.names("versions")):
            if name.isdigit():
                try:
                    return int(name), json.loads(self.files.read(f"versions/{name}"))
                except ValueError:  # its writer has not ended it; the one before is the current one
                    continue
        return 0, None

    def version(self) -> int:
        return self._current()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an older one."""
        n, entry = self._current() if version is None else (version, json.loads(self.files.read(f"versions/{version:012d}")))
        if entry is None:
            raise LookupError(f"no version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{entry['data']}")

    def replace(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes df as the version after `expected` (the current one where it is not given)."""
        before = self.version() if expected is None else expected
        data = f"data/{before + 1}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        if self.version() != before or not self.files.create(f"versions/{before + 1:012d}", json.dumps({"data": data})):
            raise Conflict(f"version {before} of {self.root} is not the current one")
        return before + 1

    def change(self, of: Callable[[DataFrame], DataFrame], attempts: int = 3) -> int:
        """Replaces the current version by what `of` makes of it; after a conflict, of the one that came between."""
        for left in reversed(range(attempts)):
            before = self.version()
            try:
                return self.replace(of(self.read(before)), before)
            except Conflict:
                if not left:
                    raise


def write_back(cities: Snapshots, updates: DataFrame, columns: list[str]) -> int:
    """The registry's next version, with updates laid over by name, in its own order."""
    return cities.change(lambda now: registry.merged(now, updates, columns))


class Scorecards:
    """The last scorecard of each suite, and its baseline, which changes only when it is promoted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _of(self, suite: str, kind: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/{kind}_{suite}")

    def save(self, card: dict, promote: bool = False) -> None:
        row = self.spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "card string").coalesce(1)
        for kind in ("latest", *(["baseline"] if promote else [])):
            self._of(card["suite"], kind).replace(row)

    def load(self, suite: str, kind: str = "latest") -> dict | None:
        kept = self._of(suite, kind)
        return json.loads(kept.read().first()["card"]) if kept.version() else None

    def fields(self, suite: str, kind: str) -> DataFrame:
        """suite, field_type and f1 of a stored card; no rows where there is none."""
        card = self.load(suite, kind) or {"fields": {}}
        return self.spark.createDataFrame([(suite, f, float(x["f1"])) for f, x in card["fields"].items()], "suite string, field_type string, f1 double")


class KeyedStore:
    """Rows by `key`; see the module."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "key string, response string"):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark, root.rstrip("/"))

    def batches(self) -> list[str]:
        return [b for b in self.files.names("batches") if self.files.exists(f"batches/{b}/_SUCCESS")]

    def read(self) -> DataFrame:
        """One row a key: of the first committed batch that has it (batches are named by time), within it of the least row."""
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/batches/{b}" for b in found]).withColumn("_batch", F.regexp_extract(F.input_file_name(), "/batches/([^/]+)/", 1))
        first = Window.partitionBy("key").orderBy("_batch", *[n for n in names if n != "key"])
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*names)

    def append(self, rows: DataFrame) -> None:
        """A new batch. Spark's commit makes it seen at once; of a task that runs twice one result is kept."""
        rows.write.parquet(f"{self.root}/batches/{time.time_ns():020d}-{uuid.uuid4().hex}")


def answered(requests: DataFrame, kept: KeyedStore, provider: Callable[[str], str], failures: tuple[type[Exception], ...] = (ValueError,)) -> DataFrame:
    """requests (prompt_version, model, request) with key and response, after asking for each key that is not in the store once.

    Equal requests share a key. New keys are dealt to tasks by hash and the provider is called there; answers are stored
    before they are read, so what is returned is what a rerun reads. A request that the provider refuses (`failures`) has
    no response, is not stored and is asked for again next time.
    """
    keyed = requests.withColumn("key", cache_key(F.col("prompt_version"), F.col("model"), F.col("request")))
    new = keyed.groupBy("key").agg(F.min("request").alias("request")).join(kept.read().select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, request in zip(pdf["key"], pdf["request"]):
                try:
                    out.append((key, provider(request)))
                except failures:
                    continue
            yield pd.DataFrame(out, columns=["key", "response"])

    if not new.isEmpty():
        kept.append(new.mapInPandas(run, "key string, response string"))
    return keyed.join(kept.read(), "key", "left")
