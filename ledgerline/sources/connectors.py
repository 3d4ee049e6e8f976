"""Connectors: landed search pages of a source as a table of meetings, read by `spark.read.format("legistar")` or `"civicplus"`.

A search (source, period, asked body) lands as pages in the order of its pager. `paged` numbers them by their "next" links,
`land` writes them so that a search is a folder, and the data sources read them: one input partition for each run of
`PAGES_PER_TASK` pages of a search. Source, period and asked body choose folders, the way the live form chooses what a search
returns, and pages of other searches are never opened: by the options `source`, `period` and `body`, which `meetings` sets,
or by filters of the query, with the option `push_filters` and after `register(spark, push_filters=True)`. Spark 4.1 keeps
what one query has pushed with the loaded DataFrame, for its later queries too; so with that option, load anew for each query.

`grid_rows` gives a page's grids to SQL, by LATERAL.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urljoin

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ledgerline.functions import constants as C
from ledgerline.sources import registry
from ledgerline.sources.html import first_rows, parse_page
from ledgerline.sources.store import written

#: Pages that one task reads.
PAGES_PER_TASK = 200
#: What a landed table is divided by; filters on the last three are pushed.
DIVIDED_BY = ["connector", "source", "period", "asked"]
MEETINGS = (
    "source string, period string, asked string, page_no long, pos int, body string, date string, time string, location string, "
    "meeting_details_url string, agenda_url string, minutes_url string, video_url string"
)
_MEETINGS = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in MEETINGS.split(", ")])
#: Attempts at reading a part that fails for a reason of the store, and the first pause between them.
ATTEMPTS, PAUSE_SECONDS = 3, 0.2


# ---- pager -------------------------------------------------------------------------------------------


def paged(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The pages that a pager reaches from its first page, with page_no from 1.

    pages: keys (the search), url, next_url (NULL: its link is missing or disabled), is_first. A link to a page that is not
    there ends the chain, so does one to a page that was seen. Links are followed by doubling: in round k from every page
    known by 2^k links at once, so a chain of n pages takes log2(n) rounds, each a join on the page's key.
    """
    at = [*keys, "url"]
    jumps = pages.where("next_url IS NOT NULL").select(*at, F.col("next_url").alias("to"))
    jumps = written(jumps.join(pages.select(*keys, F.col("url").alias("to")), [*keys, "to"], "left_semi").dropDuplicates(at), "jumps")
    seen = written(pages.where("is_first").select(*at, F.lit(1).cast("long").alias("page_no")).dropDuplicates(at), "seen")
    far, known = 1, seen.count()
    while True:
        ahead = seen.join(jumps, at).select(*keys, F.col("to").alias("url"), (F.col("page_no") + far).alias("page_no"))
        seen = written(seen.unionByName(ahead).groupBy(*at).agg(F.min("page_no").alias("page_no")), "seen")
        now = seen.count()
        if now == known:  # nobody is 2^(k-1) + 1 links away or further, and all nearer ones are known
            break
        known, far = now, 2 * far
        onward = jumps.select(*keys, F.col("url").alias("to"), F.col("to").alias("onto"))
        jumps = written(jumps.join(onward, [*keys, "to"]).select(*at, F.col("onto").alias("to")), "jumps")
    return pages.dropDuplicates(at).join(seen, at)


def next_link(html: Column) -> Column:
    """The target of a page's "next" link, NULL where it has none or it is disabled."""
    link = F.regexp_extract(html, r"""(?is)<a\b([^>]*\brel\s*=\s*["']?next\b[^>]*)>""", 1)
    disabled = link.rlike(r"""(?i)\bclass\s*=\s*["'][^"']*disabled|\baria-disabled\s*=\s*["']?true""")
    target = F.nullif(F.nullif(F.trim(F.regexp_extract(link, r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1)), F.lit("")), F.lit("#"))
    return F.when(~disabled, F.replace(target, F.lit("&amp;"), F.lit("&")))


# ---- landed pages ------------------------------------------------------------------------------------


def land(pages: DataFrame, path: str) -> None:
    """Writes connector, source, period, asked, page_no, base and html; a search is a folder, its pages in order, some in each file."""
    chosen = pages.select(*DIVIDED_BY, F.col("page_no").cast("long").alias("page_no"), "base", "html")
    part = F.floor((F.col("page_no") - 1) / PAGES_PER_TASK)
    dealt = chosen.repartition(*DIVIDED_BY, part).sortWithinPartitions(*DIVIDED_BY, "page_no")
    dealt.write.mode("append").option("maxRecordsPerFile", PAGES_PER_TASK).partitionBy(*DIVIDED_BY).parquet(path)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/", path):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def tried(work: Callable, attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS):
    """The result of work; errors of the store are tried again, after pauses that double, the last one goes on."""
    for n in range(attempts):
        try:
            return work()
        except OSError as error:
            if n == attempts - 1 or isinstance(error, FileNotFoundError):
                raise
            time.sleep(pause * 2**n)


def chosen_by(filters: list[Filter], values: dict[str, str | None]) -> bool:
    """Whether a folder of these values passes all filters."""
    for f in filters:
        value = values[f.attribute[0]]
        if isinstance(f, (EqualTo, EqualNullSafe)):
            fits = value == f.value
        elif isinstance(f, In):
            fits = value in f.value
        else:
            test = {StringContains: str.__contains__, StringStartsWith: str.startswith, StringEndsWith: str.endswith}[type(f)]
            fits = value is not None and test(value, f.value)
        if not fits:
            return False
    return True


_PUSHED = (EqualTo, EqualNullSafe, In, StringContains, StringStartsWith, StringEndsWith)


class Pages(InputPartition):
    def __init__(self, file: str, groups: list[int], values: dict[str, str | None]):
        super().__init__((file, groups))
        self.file, self.groups, self.values = file, groups, values


class LandedReader(DataSourceReader):
    def __init__(self, kind: str, path: str, chosen: tuple[Filter, ...] = ()):
        self.kind, self.path, self.filters = kind, path, list(chosen)

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        listed = tried(lambda: store.get_file_info(pafs.FileSelector(f"{root}/connector={self.kind}", recursive=True, allow_not_found=True)))
        out = []
        for info in sorted(listed, key=lambda x: x.path):
            if not info.is_file or not info.path.endswith(".parquet"):
                continue
            named = dict(part.split("=", 1) for part in info.path.split("/") if "=" in part)
            values = {k: None if named[k] == "__HIVE_DEFAULT_PARTITION__" else unquote(named[k]) for k in DIVIDED_BY[1:]}
            if chosen_by(self.filters, values):
                n = tried(lambda path=info.path: pq.ParquetFile(store.open_input_file(path)).metadata.num_row_groups)
                out.append(Pages(info.path, list(range(n)), values))
        return out or [Pages("", [], {})]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _opened(self.path)
        file = tried(lambda: pq.ParquetFile(store.open_input_file(partition.file)))
        for batch in file.iter_batches(32, row_groups=partition.groups, columns=["page_no", "base", "html"]):
            rows = []
            for page in batch.to_pylist():
                for meeting in MEETINGS_OF[self.kind](parse_page(page["html"]), partition.values["asked"], page["base"]):
                    rows.append({**partition.values, "page_no": page["page_no"], **meeting})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _MEETINGS)


class PushingReader(LandedReader):
    """Takes filters on source, period and asked body from the plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, _PUSHED) and len(f.attribute) == 1 and f.attribute[0] in DIVIDED_BY[1:]:
                self.filters.append(f)
            else:
                yield f


class _Landed(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return MEETINGS

    def reader(self, schema) -> DataSourceReader:
        equal = [EqualTo((name,), self.options[name]) for name in ("source", "period") if name in self.options]
        holds = [StringContains(("asked",), self.options["body"])] if "body" in self.options else []
        of = PushingReader if self.options.get("push_filters") == "true" else LandedReader
        return of(self.kind, self.options["path"], (*equal, *holds))


class Legistar(_Landed):
    kind = "legistar"


class CivicPlus(_Landed):
    kind = "civicplus"


def register(spark: SparkSession, push_filters: bool = False) -> SparkSession:
    """Makes the formats and `grid_rows` known to the session; see the module for `push_filters`."""
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Legistar, CivicPlus):
        spark.dataSource.register(source)
    spark.udtf.register("grid_rows", grid_rows)
    return spark


def meetings(spark: SparkSession, kind: str, path: str, source: str | None = None, period: str | None = None, body: str | None = None, limit: int | None = None) -> DataFrame:
    """Meetings of the searches that are asked for; the first `limit` of each in the order of its pages."""
    reader = register(spark).read.format(kind).option("path", path)
    for name, value in (("source", source), ("period", period), ("body", body)):  # the form takes a body whose name holds what is asked for
        reader = reader if value is None else reader.option(name, value)
    df = reader.load()
    return first_rows(df.withColumn("_at", F.struct("page_no", "pos")), DIVIDED_BY[1:], "_at", limit).drop("_at")


def _reader(kind: str) -> Callable:
    def read(spark: SparkSession, entry: dict, period: str | None = None, body: str | None = None, limit: int | None = None) -> DataFrame:
        return meetings(spark, kind, entry["landed"], entry.get("name"), period, body or entry.get("body"), limit)

    return read


for _kind in (Legistar.kind, CivicPlus.kind):
    registry.connector(_kind)(_reader(_kind))


# ---- pages to meetings, row by row -----------------------------------------------------------------------


def _clean(text: str | None) -> str | None:
    return (text or "").replace("\xa0", " ").strip() or None


def _target(cell: dict | None, base: str | None) -> str | None:
    """A cell's real link: its href unless empty or '#', else what onclick opens, made absolute."""
    if cell is None:
        return None
    href = (cell["href"] or "").strip(" ")
    if href in ("", "#"):
        opened = re.search(r"window\.open\(\s*'([^']+)'", cell["onclick"] or "")
        href = opened[1] if opened else ""
    return (href if re.match("https?://", href) else urljoin(base or "", href)) if href else None


def grid_table(grid: dict) -> Iterator[tuple[int, dict[str, dict]]]:
    """(place, cell by lower-cased header) of a grid's data rows; of equal headers the first counts."""
    heads = [r for r in grid["rows"] if any(c["header"] and C.HEADER_CLASS in c["css"] for c in r["cells"])]
    heads += [r for r in grid["rows"] if any(c["header"] for c in r["cells"]) and C.PAGER_CLASS not in r["css"]]
    names = [c["text"].lower() for c in (heads[0]["cells"] if heads else []) for _ in range(c["span"])]
    for pos, row in enumerate(grid["rows"]):
        if any(not c["header"] for c in row["cells"]) and C.PAGER_CLASS not in row["css"]:
            cells: dict[str, dict] = {}
            for name, cell in zip(names, row["cells"]):
                cells.setdefault(name, cell)
            yield pos, cells


def calendar_meetings_of(page: dict, asked: str | None, base: str | None) -> Iterator[dict]:
    for grid in page["grids"]:
        if not grid["id"].endswith(C.CALENDAR_GRID):
            continue
        for pos, cells in grid_table(grid):
            cell = lambda name, cells=cells: cells.get(name) or cells.get(C.COLUMN_ALIASES.get(name, name))
            text = lambda name, cell=cell: _clean(cell(name)["text"]) if cell(name) else None
            if cell("meeting date") is not None:
                links = {k: _target(cell(n), base) for k, n in (("meeting_details_url", "meeting details"), ("agenda_url", "agenda"), ("minutes_url", "minutes"), ("video_url", "video"))}
                yield {"pos": pos, "body": text("name") or asked, "date": cell("meeting date")["text"], "time": text("meeting time"), "location": text("meeting location"), **links}


def agenda_body(title: str) -> str | None:
    """The body that an agenda's title names; see html.body_of_title."""
    _, named, rest = title.lower().partition("agenda for")
    words = title[len(title) - len(rest) :].split() if named and len(title.lower()) == len(title) else []
    words = words[1:] if words[:1] and words[0].lower() == "the" else words
    if len(words) < 4 or not (re.fullmatch(r"\w+", words[0]) and re.fullmatch(r"\d+,", words[1]) and words[2].isdigit()):
        return None
    named_words = words[3:-1] if len(words) > 4 and words[-1].lower() in ("meeting", "meeting.") else words[3:]
    return " ".join(named_words)


def agenda_center_meetings_of(page: dict, asked: str | None, base: str | None) -> Iterator[dict]:
    rows = [r for grid in page["grids"] for r in grid["rows"]]
    for pos, row in enumerate(rows):
        label = next((c["label"] for c in row["cells"] if c["label"] is not None), None)
        if C.AGENDA_ROW_CLASS not in row["css"] or label is None:
            continue
        linked = [x for c in row["cells"] for x in c["links"]]
        agenda = next((x for x in linked if x["href"] and "/AgendaCenter/ViewFile/Agenda/" in x["href"]), None)
        to = lambda href: None if href is None else href if re.match("https?://", href) else urljoin(base or "", href)
        of_class = lambda css: next((x["href"] for c in [c for c in row["cells"] if css in re.split(r"\s+", c["css"])][:1] for x in c["links"]), None)
        url = to(agenda["href"]) if agenda else None
        yield {
            "pos": pos, "body": agenda_body(agenda["text"] if agenda else "") or asked, "date": label.replace("Agenda for ", "").strip(" "), "time": None, "location": None,
            "meeting_details_url": url, "agenda_url": url, "minutes_url": to(of_class("minutes")), "video_url": to(of_class("media")),
        }


MEETINGS_OF = {Legistar.kind: calendar_meetings_of, CivicPlus.kind: agenda_center_meetings_of}


@F.udtf(returnType="grid string, pos int, cells map<string, struct<text: string, target: string>>", useArrow=True)
class grid_rows:  # noqa: N801  (its name in SQL)
    """SELECT ... FROM pages, LATERAL grid_rows(html, base): the data rows of a page's grids, cells by lower-cased header."""

    def eval(self, html: str, base: str):
        for grid in parse_page(html)["grids"]:
            for pos, cells in grid_table(grid):
                yield grid["id"], pos, {k: (_clean(c["text"]), _target(c, base)) for k, c in cells.items()}
