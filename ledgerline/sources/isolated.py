"""Ingest in which a source that fails stops no other: rows of the good ones, an error row for each bad one, counts of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.sources.connectors import MEETINGS_OF
from ledgerline.sources.html import parse_page
from ledgerline.sources.store import written

#: Characters of an error's text that are kept.
ERROR_CHARS = C.NOTE_CHARS
_ROW = "source string, page_id long, pos int, body string, date string, time string, location string, meeting_details_url string, agenda_url string, minutes_url string, video_url string, error string"
_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in _ROW.split(", ")])
#: (kind, html, asked body, base) -> meetings as dicts. It may raise; the page's source then counts as failed.
Reader = Callable[[str, str, str, str], Iterator[dict]]


def read_page(kind: str, html: str, asked: str, base: str) -> Iterator[dict]:
    if kind not in MEETINGS_OF:
        raise ValueError(f"no connector named {kind!r}")
    return MEETINGS_OF[kind](parse_page(html), asked, base)


@dataclass
class Ingested:
    """meetings of sources without an error; errors: source, pages (that failed), page_id and error of the first of them."""

    meetings: DataFrame
    errors: DataFrame
    sources: DataFrame
    #: pages, failed pages and meetings of the run, as its tasks counted them
    counts: dict[str, int]


def ingest(pages: DataFrame, reader: Reader = read_page) -> Ingested:
    """pages: page_id, source, connector, asked, base, html.

    Every page is read in one pass whose rows, meetings and errors alike, are written once; both outputs come from there.
    A source one of whose pages fails has no meetings, as one that breaks off half-way has none to rely on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                rows = [{"source": page["source"], "page_id": page["page_id"], "pos": -1}]  # the page itself, with its error if it has one
                try:
                    rows += [{"source": page["source"], "page_id": page["page_id"], **m} for m in reader(page["connector"], page["html"], page["asked"], page["base"])]
                except Exception as error:  # whatever a reader raises is the row of its source, not the end of the run
                    rows = [{**rows[0], "error": f"{type(error).__name__}: {error}"[:ERROR_CHARS]}]
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    counted = Observation("ingest")
    read = pages.select("page_id", "source", "connector", "asked", "base", "html").mapInArrow(run, _ROW)
    read = read.observe(counted, F.count_if(F.col("pos") == -1).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("pos") >= 0).alias("meetings"))
    rows = written(read, "ingested")
    errors = rows.where("error IS NOT NULL").groupBy("source").agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "error")).alias("first")).select("source", "pages", "first.page_id", "first.error")
    good = rows.where("pos >= 0").join(errors.select("source"), "source", "left_anti").drop("error")
    by_source = rows.groupBy("source").agg(F.count_if(F.col("pos") == -1).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("pos") >= 0).alias("found"))
    status = F.when(F.col("failed") > 0, "error").when(F.col("found") > 0, "ok").otherwise("empty")
    return Ingested(good, errors, by_source.select("source", "pages", "failed", F.when(F.col("failed") > 0, 0).otherwise(F.col("found")).alias("meetings"), status.alias("status")), counted.get)
