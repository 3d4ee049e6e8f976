"""URL, path and key functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerline.functions import constants as C
from ledgerline.functions.text import not_empty, stripped


def content_address(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def cache_key(version: Column, model: Column, canonical_json: Column) -> Column:
    return F.concat_ws("__", version, model, F.substring(F.sha2(canonical_json, 256), 1, 24))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def extension(url: Column, mime: Column | None = None) -> Column:
    """From the MIME type, else the URL's suffix, else .bin."""
    suffix = not_empty(F.lower(F.regexp_extract(url_path(url), r"[^/](\.[^./]+)$", 1)))
    if mime is None:
        return F.coalesce(suffix, F.lit(".bin"))
    kind = F.trim(F.lower(F.split(mime, ";")[0]))
    by_mime = F.lit(None).cast("string")
    for name, ext in C.MIME_EXTENSIONS.items():
        by_mime = F.when(kind == name, F.lit(ext)).otherwise(by_mime)
    return F.coalesce(by_mime, suffix, F.lit(".bin"))


def base_url(homepage: Column) -> Column:
    """Scheme and authority (the port stays)."""
    return F.regexp_extract(homepage, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def calendar_root(url: Column) -> Column:
    """Scheme and host of a legistar calendar with its page, NULL for other URLs."""
    return F.when(url.rlike(r"(?i)legistar\.com"), F.concat(not_empty(F.regexp_extract(url, r"(?i)^(https?://[^/]*legistar\.com)", 1)), F.lit("/Calendar.aspx")))


def calendar_root_in(text: Column) -> Column:
    """The calendar page of the first legistar host that a text names, NULL where it names none."""
    found = not_empty(F.lower(F.regexp_extract(text, r"(?i)https?://([a-z0-9-]+\.legistar\.com)", 1)))
    return F.concat(F.lit("https://"), found, F.lit("/Calendar.aspx"))


def platform(url: Column, html: Column) -> Column:
    """The first platform whose pattern stands in the URL or the first part of the page; NULL if none does."""
    seen = F.concat_ws("\n", url, F.substring(html, 1, C.HTML_SCAN_CHARS))
    return F.coalesce(*[F.when(seen.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in C.PLATFORM_PATTERNS])


def subdomain_slugs(name: Column) -> Column:
    plain = F.lower(stripped(name))
    tight, dashed = F.replace(plain, F.lit(" "), F.lit("")), F.replace(plain, F.lit(" "), F.lit("-"))
    return F.array(tight, dashed, F.concat(tight, F.lit("ca")), F.concat(dashed, F.lit("-ca")))


@F.pandas_udf(StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base, by the standard rules."""
    from urllib.parse import urljoin

    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)], dtype=object)


def absolute(base: Column, href: Column) -> Column:
    """join_url, called only for hrefs that are not absolute."""
    return F.when(href.rlike("^https?://"), href).otherwise(join_url(base, href))


def month_range(day: Column) -> tuple[Column, Column]:
    return F.date_format(F.trunc(day, "MM"), "MM/dd/yyyy"), F.date_format(F.last_day(day), "MM/dd/yyyy")


def search_url(base: Column, period: Column, category: Column, today: Column) -> Column:
    """The agenda search of a period: explicit dates for "this month", else one of four selectors."""
    p = F.lower(F.trim(period))
    start, end = month_range(today)
    selector = F.lit(C.DEFAULT_SELECTOR)
    for name, value in C.PERIOD_SELECTORS.items():
        selector = F.when(p == name, F.lit(value)).otherwise(selector)
    dates = F.when(p == "this month", F.concat(F.lit("&startDate="), start, F.lit("&endDate="), end, F.lit("&dateRange=&dateSelector="))).otherwise(F.concat(F.lit("&startDate=&endDate=&dateRange=&dateSelector="), selector.cast("string")))
    return F.concat(base, F.lit("/AgendaCenter/Search/?term=&CIDs="), category, F.lit(","), dates)


def meeting_date(text: Column) -> Column:
    """A DATE from either rendering that sources use; NULL for others."""
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "MMMM d, yyyy"))
