"""The registry of sources: loading, filters, seeding, detection of platforms, merging back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions.text import not_empty
from ledgerline.functions.urls import base_url, calendar_root, calendar_root_in, platform

CITIES = "pos int, name string, homepage string, platform string, connector string, agenda_url string, body string, root_url string, category_id string, category_name string, status string, note string"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows from a YAML list (read through Spark as one text), in their order."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    names = [f.split()[0] for f in CITIES.split(", ")][1:]
    alias = {"legistar_url": "root_url", "civicplus_base_url": "root_url", "civicplus_category_id": "category_id", "civicplus_category_name": "category_name", "civicplus_status": "status", "civicplus_note": "note"}
    rows = []
    for i, entry in enumerate(yaml.safe_load(text) or []):
        flat = {alias.get(k, k): v for k, v in entry.items()}
        rows.append((i, *(None if flat.get(n) is None else str(flat[n]) for n in names)))
    return spark.createDataFrame(rows, CITIES)


def active(cities: DataFrame, connector: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Cities with a connector, of one kind and with a name part if asked; the first `limit` in registry order."""
    df = cities.where("connector IS NOT NULL")
    if connector:
        df = df.where(F.col("connector") == connector)
    if name:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return df.orderBy("pos").limit(limit) if limit else df


def of_platform(cities: DataFrame, kind: str = "legistar") -> DataFrame:
    return cities.where(F.col("platform") == kind).select(F.col("name").alias("jurisdiction"), "root_url", F.coalesce("body", F.lit(C.DEFAULT_BODY)).alias("body"))


CONNECTORS: dict[str, Callable] = {}


def connector(kind: str) -> Callable:
    """Registers a reader: (spark, entry, period, body, limit) -> meetings."""

    def put(reader: Callable) -> Callable:
        CONNECTORS[kind] = reader
        return reader

    return put


def reader_of(entry: dict) -> Callable:
    if entry.get("connector") not in CONNECTORS:
        raise ValueError(f"no connector named {entry.get('connector')!r}")
    return CONNECTORS[entry["connector"]]


def seeded(spark: SparkSession, csv_path: str, verified: DataFrame) -> DataFrame:
    """Registry rows of a CSV of name, homepage, URL (later commas belong to the URL), verified rows laid over."""
    parts = F.split("value", ",", 3)
    part = lambda i: not_empty(F.trim(F.get(parts, F.lit(i))))
    rows = spark.read.text(csv_path).where("trim(value) != ''").select(part(0).alias("name"), part(1).alias("homepage"), part(2).alias("agenda_url"))
    over = verified.select("name", *[F.col(c).alias(f"v_{c}") for c in ("homepage", "agenda_url")])
    df = rows.join(over, "name", "left").select("name", F.coalesce("v_homepage", "homepage").alias("homepage"), F.coalesce("v_agenda_url", "agenda_url").alias("agenda_url"))
    return df.withColumn("root_url", calendar_root(F.col("agenda_url")))


def detected(probes: DataFrame) -> DataFrame:
    """Platform and calendar page from landed probes (name, final_url, html), of subdomain probes (name, slug_url, reached) where those find no platform.

    The calendar page is that of the address reached, else of the first one that the page's text names.
    """
    found = F.coalesce(platform(F.col("final_url"), F.col("html")), F.when(F.col("reached"), F.lit("legistar")))
    return probes.select("name", found.alias("platform"), F.coalesce(calendar_root(F.col("final_url")), calendar_root_in(F.col("html"))).alias("root_url"))


def probe_status(probes: DataFrame) -> DataFrame:
    """Status of category probes. probes: name, homepage, error, has_center, category."""
    status = F.when(F.col("error").isNotNull(), "error").when(~F.col("has_center"), "no_agenda_center").when(F.col("category").isNull(), "no_council_category").otherwise("ok")
    return probes.select("name", base_url(F.col("homepage")).alias("root_url"), status.alias("status"), F.left("error", F.lit(C.NOTE_CHARS)).alias("note"))


def pending(cities: DataFrame) -> DataFrame:
    return cities.where("status IS NULL")


def merged(cities: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """The registry with updates laid over by name, in its own order."""
    new = updates.select("name", *[F.col(c).alias(f"n_{c}") for c in columns])
    df = cities.join(new, "name", "left")
    return df.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in columns else F.col(c) for c in cities.columns]).orderBy("pos")


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def the_one(df: DataFrame, what: str) -> dict:
    """The single row; none or several is an error of this stage."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{what}: {'none' if not rows else 'more than one'} found")
    return rows[0].asDict()


def has_text(column: Column) -> Column:
    return not_empty(column).isNotNull()
