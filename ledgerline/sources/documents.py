"""Fetched documents: content-addressed cache, text of files, section split, choice of documents and meetings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions.text import not_empty, slug
from ledgerline.functions.urls import content_address, extension


def requests(urls: DataFrame) -> DataFrame:
    """url, jurisdiction -> with address and the place a document is kept at."""
    address = content_address(F.col("url"))
    return urls.withColumns({"address": address, "path": F.concat_ws("/", slug(F.col("jurisdiction")), F.concat(address, extension(F.col("url"))))})


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests not stored yet, each address once."""
    return wanted.dropDuplicates(["address"]).join(stored.select("address"), "address", "left_anti")


def store(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").parquet(path)


def ocr_required(text: Column, pages: Column) -> Column:
    """Fewer characters a page than a text layer would give; no page, no need."""
    kept = F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", ""))
    return F.when(pages > 0, kept / pages < C.OCR_CHARS_PER_PAGE).otherwise(False)


def read_files(spark: SparkSession, path: str, pdf_text: Callable[[bytes], tuple[str, int]] | None = None) -> DataFrame:
    """path, text, page_count, ocr_required of files. PDFs need `pdf_text`; without it they have no text and are quarantined."""
    files = spark.read.format("binaryFile").load(path)
    plain = files.where(~F.lower("path").endswith(".pdf")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(1).alias("page_count"), F.lit(False).alias("ocr_required"))
    pdfs = files.where(F.lower("path").endswith(".pdf")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [pdf_text(bytes(c)) if pdf_text else ("", 1) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in got], "page_count": [n for _, n in got]})

    texts = pdfs.mapInPandas(run, "path string, text string, page_count int")
    return plain.unionByName(texts.withColumn("ocr_required", ocr_required(F.col("text"), F.col("page_count"))))


def sections(text: Column) -> Column:
    """MAP of section name to text: from each listed header line to the next; of equal names the last. The whole text is '_full_text'."""
    names = "|".join(C.REPORT_SECTIONS)
    header = rf"(?im)^[ \t]*({names})[ \t]*:?[ \t]*$"
    marked = F.regexp_replace(text, header, "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    pairs = F.transform(parts, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, "\u0002", 1))).alias("k"), F.regexp_replace(F.substring_index(p, "\u0002", -1), r"(?U)^\s+|\s+\z", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.array_append(last, F.struct(F.lit("_full_text").alias("k"), text.alias("v"))))


def report_text(found: Column) -> Column:
    """The priority sections that are there, else the first part of the whole text."""
    parts = [F.concat(F.lit(f"=== {s} ===\n"), F.try_element_at(found, F.lit(s))) for s in C.PRIORITY_SECTIONS]
    return F.coalesce(not_empty(F.concat_ws("\n\n", *parts)), F.left(F.try_element_at(found, F.lit("_full_text")), F.lit(C.FALLBACK_CHARS)))


def chosen_url() -> Column:
    """Minutes, else agenda; empty counts as missing."""
    return F.coalesce(not_empty(F.col("minutes_url")), not_empty(F.col("agenda_url")))


def selected_meetings(meetings: DataFrame, selector: str, key: str = "jurisdiction") -> DataFrame:
    """Per city the first meeting whose date holds the selector and that has a details page."""
    fit = meetings.where(F.contains("date", F.lit(selector)) & not_empty(F.col("meeting_details_url")).isNotNull())
    return fit.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("_n = 1").drop("_n")


def with_fallback_period(meetings: DataFrame, period: str, fallback: str, key: str = "jurisdiction") -> DataFrame:
    """Per city the rows of the period if one of them has a details page, else those of the fallback period."""
    has = F.max((F.col("period") == period) & not_empty(F.col("meeting_details_url")).isNotNull()).over(Window.partitionBy(key))
    return meetings.withColumn("_has", F.coalesce(has, F.lit(False))).where(F.col("period") == F.when(F.col("_has"), period).otherwise(fallback)).drop("_has")


def first_with_agenda(candidates: DataFrame, key: str = "jurisdiction") -> DataFrame:
    """Per city the first candidate meeting whose agenda has entries."""
    return candidates.where(F.size("entries") > 0).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("_n = 1").drop("_n")
