"""Catalogue queries of the ingest side: landed searches, pagers, connectors and table functions, over pages of the driver's table.

A page's menu links stand in for the meetings of a search page, the language part of its URL for the body, its domain for
the source. `search_pages` writes a calendar (or an agenda center) from them; the SQL reads the same links from the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import schemas as M
from ledgerline.operators import style as Y
from ledgerline.plans.catalogue import query, table
from ledgerline.sources import connectors as K
from ledgerline.sources import html as H
from ledgerline.sources import isolated as G
from ledgerline.sources import snapshots as N
from ledgerline.sources import store as S

_LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'
_SITE, _LANG = r"^https?://[^/]*?([a-z]+\.[a-z]+)/", r"^https?://[^/]+/([a-z]+)/"


def search_pages(spark, sf_dir, kind: str = "legistar") -> DataFrame:
    """page_id, connector, source, period, asked, url, base and html of a search page for each page of the table."""
    p = table(spark, sf_dir, "pages")
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)).alias("text"))
    if kind == "legistar":
        head = '<table id="ctl00_gridCalendar_ctl00"><tr class="rgPager"><td>1</td></tr><tr><th class="rgHeader">Body</th><th class="rgHeader">Date</th><th class="rgHeader">Meeting Time</th><th class="rgHeader">Meeting Details</th><th class="rgHeader">Agenda</th></tr>'
        row = lambda x, i: F.concat(  # noqa: E731  every third has no name, every second opens its agenda by script
            F.lit("<tr><td>"), F.when(i % 3 == 2, "&nbsp;").otherwise(x["text"]), F.lit("</td><td>"), (i + 1).cast("string"), F.lit("/2/2026</td><td> </td><td><a href='"), x["href"], F.lit("'>d</a></td><td><a href='"),
            F.when(i % 2 == 1, F.concat(F.lit("#' onclick=\"window.open('"), x["href"], F.lit(".pdf')\">a</a>"))).otherwise(F.concat(x["href"], F.lit(".pdf'>a</a>"))), F.lit("</td></tr>"))
        tail = "</table>"
    else:
        head, tail = "<table>", "</table>"
        row = lambda x, i: F.concat(
            F.lit('<tr class="catAgendaRow"><td><strong aria-label="Agenda for May '), (i + 1).cast("string"), F.lit(', 2025"></strong><a href="/AgendaCenter/ViewFile/Agenda/_'), (i + 1).cast("string"), F.lit('">Agenda for the May 6, 2025 '),
            x["text"], F.lit(' Meeting</a></td><td class="minutes"><a href="'), x["href"], F.lit('">m</a></td></tr>'))
    period = F.element_at(F.array(F.lit("this month"), F.lit("last month"), F.lit("last year")), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(
        "page_id", F.lit(kind).alias("connector"), F.regexp_extract("url", _SITE, 1).alias("source"), period.alias("period"), F.regexp_extract("url", _LANG, 1).alias("asked"), "url",
        F.concat(F.lit("https://"), F.regexp_extract("url", _SITE, 1), F.lit("/")).alias("base"), F.concat(F.lit(head), F.array_join(F.transform(links, row), ""), F.lit(tail)).alias("html"),
    )


def _chained(spark, sf_dir) -> DataFrame:
    """Every 20 pages in a row are a search; in some of them the pager comes back to a page seen, in some a page is missing."""
    p = search_pages(spark, sf_dir).withColumns({"search": F.floor(F.col("page_id") / 20), "n": F.col("page_id") % 20, "url": F.concat("url", F.lit("&p="), F.col("page_id").cast("string"))})
    ahead = p.select("search", (F.col("n") - 1).alias("n"), F.col("url").alias("next_url"))
    back = p.where("n = 3").select("search", F.lit(15).cast("long").alias("n"), F.col("url").alias("back_url"))
    p = p.join(ahead, ["search", "n"], "left").join(back, ["search", "n"], "left").withColumn("next_url", F.when(F.col("search") % 3 == 1, F.coalesce("back_url", "next_url")).otherwise(F.col("next_url"))).drop("back_url")
    return p.where("NOT (search % 3 = 2 AND n = 11)").withColumn("is_first", F.col("n") == 0)


@query(r"""WITH RECURSIVE p AS (SELECT page_id, page_id // 20 AS search, page_id % 20 AS n FROM pages WHERE NOT (page_id // 20 % 3 = 2 AND page_id % 20 = 11)),
nexts AS (SELECT a.page_id, b.page_id AS next_id FROM p a JOIN p b ON a.search = b.search AND b.n = CASE WHEN a.search % 3 = 1 AND a.n = 15 THEN 3 ELSE a.n + 1 END),
chain AS (SELECT page_id, 1 AS page_no FROM p WHERE n = 0 UNION ALL SELECT x.next_id, c.page_no + 1 FROM chain c JOIN nexts x ON x.page_id = c.page_id WHERE c.page_no < 25)
SELECT page_id, CAST(min(page_no) AS BIGINT) AS page_no FROM chain GROUP BY 1""")
def pager_chains(spark, sf_dir):
    return K.paged(_chained(spark, sf_dir), ["search"]).select("page_id", "page_no")


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 3 THEN url || '?a=1&b=2' END AS next_url FROM pages""")
def next_links(spark, sf_dir):
    """Links of four kinds: plain, disabled by class, without a target, and with an escaped query."""
    kind = F.col("page_id") % 4
    link = F.when(kind == 0, F.concat(F.lit('<a class="p" rel="next" href="'), "url", F.lit('">Next</a>'))).when(kind == 1, F.concat(F.lit('<a rel=next class="btn disabled" href="'), "url", F.lit('">Next</a>')))
    link = link.when(kind == 2, F.lit('<a rel="next" href="#">Next</a>')).otherwise(F.concat(F.lit("<A HREF='"), "url", F.lit("?a=1&amp;b=2' REL='next'>Next</A>")))
    return table(spark, sf_dir, "pages").select("page_id", K.next_link(F.concat("html", link)).alias("next_url"))


def _landed(spark, sf_dir, kind: str) -> str:
    path = S.new_path(spark, f"landed-{kind}")
    K.land(search_pages(spark, sf_dir, kind).withColumn("page_no", F.col("page_id") + 1), path)
    return path


_LINKS = rf"""(SELECT page_id, regexp_extract(url, '{_SITE}', 1) AS source, list_extract(['this month', 'last month', 'last year'], CAST(page_id % 3 + 1 AS INTEGER)) AS period, regexp_extract(url, '{_LANG}', 1) AS asked,
unnest(range(len(h))) AS i, unnest(h) AS href, unnest(x) AS text FROM (SELECT *, regexp_extract_all(html, '{_LINK}', 1) AS h, regexp_extract_all(html, '{_LINK}', 2) AS x FROM pages))"""
_TIDY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_UNESCAPED = "replace(replace({}, '&amp;', '&'), '&quot;', '\"')"


def _decoded(sql: str) -> str:
    return _UNESCAPED.format(sql)


_CALENDAR_SQL = f"""SELECT source, period, asked, page_id + 1 AS page_no, CASE WHEN i % 3 = 2 OR {_decoded(_TIDY)} = '' THEN asked ELSE {_decoded(_TIDY)} END AS body, (i + 1) || '/2/2026' AS date,
'https://' || source || {_decoded('href')} AS details, 'https://' || source || {_decoded('href')} || '.pdf' AS agenda FROM {_LINKS}"""


def _calendar(df: DataFrame) -> DataFrame:
    return df.select("source", "period", "asked", "page_no", "body", "date", F.col("meeting_details_url").alias("details"), F.col("agenda_url").alias("agenda"))


@query(_CALENDAR_SQL)
def legistar_scan(spark, sf_dir):
    return _calendar(K.meetings(spark, "legistar", _landed(spark, sf_dir, "legistar")))


@query(f"SELECT * FROM ({_CALENDAR_SQL}) WHERE period = 'last month' AND contains(asked, 'e')")
def legistar_pushdown(spark, sf_dir):
    K.register(spark, push_filters=True)
    return _calendar(spark.read.format("legistar").option("path", _landed(spark, sf_dir, "legistar")).option("push_filters", "true").load().where("period = 'last month' AND asked LIKE '%e%'"))


@query(f"SELECT * FROM ({_CALENDAR_SQL}) WHERE period = 'last year' AND contains(asked, 'f') AND source = 'example.com'")
def legistar_asked(spark, sf_dir):
    return _calendar(K.meetings(spark, "legistar", _landed(spark, sf_dir, "legistar"), source="example.com", period="last year", body="f"))


@query(f"""SELECT source, period, asked, page_id + 1 AS page_no, CASE WHEN {_decoded(_TIDY)} = '' THEN asked ELSE {_decoded(_TIDY)} END AS body, 'May ' || (i + 1) || ', 2025' AS date,
'https://' || source || '/AgendaCenter/ViewFile/Agenda/_' || (i + 1) AS agenda_url, 'https://' || source || {_decoded('href')} AS minutes_url FROM {_LINKS}""")
def civicplus_scan(spark, sf_dir):
    return K.meetings(spark, "civicplus", _landed(spark, sf_dir, "civicplus")).select("source", "period", "asked", "page_no", "body", "date", "agenda_url", "minutes_url")


@query(_CALENDAR_SQL)
def grid_rows_in_sql(spark, sf_dir):
    """The same meetings by SQL text over the table function."""
    K.register(spark)
    return spark.sql(
        """SELECT p.source, p.period, p.asked, p.page_id + 1 AS page_no, coalesce(g.cells['body'].text, p.asked) AS body, g.cells['date'].text AS date, g.cells['meeting details'].target AS details, g.cells['agenda'].target AS agenda
        FROM {pages} p, LATERAL grid_rows(p.html, p.base) g WHERE endswith(g.grid, 'gridCalendar_ctl00') AND g.cells['date'] IS NOT NULL""",
        pages=search_pages(spark, sf_dir),
    )


# ---- stores, snapshots, isolation -------------------------------------------------------------------------


@query("""SELECT page_id, 'v1__m__' || substr(sha256(q), 1, 24) AS key, CASE WHEN q <> 'en' THEN upper(q) || '/' || length(q) END AS response FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS q FROM pages)""")
def stored_answers(spark, sf_dir):
    """Answers of a provider that refuses one request; each distinct request is asked for once, over two runs too."""
    kept = N.KeyedStore(spark, S.new_path(spark, "answers"))

    def provider(request: str) -> str:
        if request == "en":
            raise ValueError("refused")
        return f"{request.upper()}/{len(request)}"

    asked = table(spark, sf_dir, "pages").select("page_id", F.lit("v1").alias("prompt_version"), F.lit("m").alias("model"), F.regexp_extract("url", _LANG, 1).alias("request"))
    N.answered(asked.where("page_id % 2 = 0"), kept, provider)
    return N.answered(asked, kept, provider).select("page_id", "key", "response")


@query("""SELECT key, min(page_id) AS page_id FROM (SELECT page_id, substr(url, 1, 20) AS key FROM pages) GROUP BY key""")
def keyed_appends(spark, sf_dir):
    """Three batches with keys in common, one of them twice: one row a key, of the first batch."""
    kept = N.KeyedStore(spark, S.new_path(spark, "keyed"), "key string, page_id long")
    p = table(spark, sf_dir, "pages").select(F.substring("url", 1, 20).alias("key"), "page_id")
    top = p.agg(F.max("page_id")).first()[0] or 0
    for low, high in ((0, top // 3), (0, top // 3), (top // 3, top // 2), (top // 2, top + 1)):
        kept.append(p.where(F.col("page_id").between(low, high)))
    return kept.read()


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'granicus' WHEN c_custkey % 3 = 0 THEN 'legistar' ELSE c_mktsegment END AS platform, c_custkey % 7 = 0 AS changed FROM customer""")
def registry_snapshots(spark, sf_dir):
    """A registry after two written-back updates and one that conflicts, beside what differs from its first version."""
    c = table(spark, sf_dir, "customer")
    cities = c.select(F.col("c_custkey").cast("int").alias("pos"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("platform"), F.lit("old").alias("note"))
    kept = N.Snapshots(spark, S.new_path(spark, "registry"))
    first = kept.replace(cities)
    N.write_back(kept, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.lit("legistar").alias("platform")), ["platform"])
    try:
        kept.replace(cities.withColumn("platform", F.lit("lost")), expected=first)
        raise AssertionError("a change of an old version went through")
    except N.Conflict:
        pass
    N.write_back(kept, c.where("c_custkey % 5 = 0").select(F.col("c_name").alias("name"), F.lit("granicus").alias("platform")), ["platform"])
    N.write_back(kept, c.where("c_custkey % 7 = 0").select(F.col("c_name").alias("name"), F.lit("new").alias("note")), ["note"])
    old = kept.read(first).select("name", F.col("note").alias("was"))
    return kept.read().join(old, "name").select("name", "platform", (F.col("note") != F.col("was")).alias("changed"))


_BROKEN = "length(html) % 53 = 7"
_SOURCED = rf"(SELECT *, regexp_extract(url, '{_SITE}', 1) || '/' || page_id % 40 AS source FROM pages)"
_FAILED = f"(SELECT source, count(*) AS failed, min(page_id) AS first_page FROM {_SOURCED} WHERE {_BROKEN} GROUP BY 1)"


def _ingested(spark, sf_dir):
    """Pages whose length leaves 7 of 53 make their reader fail."""
    p = search_pages(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.expr(_BROKEN).alias("broken")), "page_id")
    p = p.withColumns({"source": F.concat("source", F.lit("/"), (F.col("page_id") % 40).cast("string")), "connector": F.when(F.col("broken"), "gopher").otherwise(F.col("connector"))})
    return G.ingest(p)


@query(f"""SELECT p.source, count(DISTINCT p.page_id) AS pages, coalesce(max(f.failed), 0) AS failed, CASE WHEN max(f.failed) > 0 THEN 0 ELSE CAST(sum(len(regexp_extract_all(html, '{_LINK}'))) AS BIGINT) END AS meetings,
CASE WHEN max(f.failed) > 0 THEN 'error' WHEN sum(len(regexp_extract_all(html, '{_LINK}'))) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {_SOURCED} p LEFT JOIN {_FAILED} f ON f.source = p.source GROUP BY 1""")
def isolated_sources(spark, sf_dir):
    return _ingested(spark, sf_dir).sources


@query(f"SELECT source, failed AS pages, first_page AS page_id, 'ValueError: no connector named ''gopher''' AS error FROM {_FAILED}")
def ingest_errors(spark, sf_dir):
    return _ingested(spark, sf_dir).errors


@query(f"SELECT p.page_id, CAST(count(*) AS BIGINT) AS meetings FROM (SELECT *, unnest(regexp_extract_all(html, '{_LINK}')) FROM {_SOURCED}) p WHERE p.source NOT IN (SELECT source FROM {_FAILED}) GROUP BY 1")
def ingested_meetings(spark, sf_dir):
    return _ingested(spark, sf_dir).meetings.groupBy("page_id").agg(F.count("*").alias("meetings"))


# ---- schemas, categories, style cases -----------------------------------------------------------------------

_TYPE = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END"


@query(f"""WITH o AS (SELECT column_name AS path, {_TYPE} AS t FROM (DESCRIBE documents)), n AS (SELECT column_name AS path, CASE column_name WHEN 'text' THEN 'bigint' ELSE {_TYPE} END AS t FROM (DESCRIBE pages)
UNION ALL SELECT 'text', 'bigint' UNION ALL SELECT 'body', 'struct' UNION ALL SELECT 'body.links', 'list' UNION ALL SELECT 'body.links[]', 'string' UNION ALL SELECT 'body.' || column_name, {_TYPE} FROM (DESCRIBE labels))
SELECT path, CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'removed' ELSE 'retyped' END AS change, o.t AS old_type, n.t AS new_type FROM o FULL JOIN n USING (path) WHERE o.t IS DISTINCT FROM n.t""")
def schema_differences(spark, sf_dir):
    """What a table of documents would have to change to become one of pages with a nested body."""
    labels = F.struct(*[F.col(x) for x in table(spark, sf_dir, "labels").columns], F.array(F.lit("x")).cast("array<string>").alias("links"))
    nested = table(spark, sf_dir, "labels").select(labels.alias("body"), F.length(F.lit("x")).cast("bigint").alias("text"))
    new = T.StructType([*table(spark, sf_dir, "pages").schema.fields, *nested.schema.fields])
    return M.differences(M.as_table(spark, table(spark, sf_dir, "documents").schema), M.as_table(spark, new))


def _menus(spark, sf_dir):
    """(wanted, found): the first word of each page's title, and the page's menu; every 7th has its id already."""
    entity = lambda c: F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), "html")
    found = pages.select("source", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(2))).alias("pos", "text"))
    found = found.select("source", "pos", F.lower(entity(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("category"), F.concat(F.lit("c"), F.col("pos").cast("string")).alias("category_id"))
    title = F.split_part(F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), F.lit(" "), F.lit(1))
    return pages.select("source", title.alias("name"), F.when(F.col("source") % 7 == 0, "kept").when(F.col("source") % 7 == 1, "").alias("cached_id")), found


_WORDS = rf"(SELECT page_id, lower({_decoded(_TIDY)}) AS category, 'c' || i AS category_id, i AS pos FROM {_LINKS})"
_WANTED = "(SELECT page_id, lower(split_part(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ' ', 1)) AS name, CASE WHEN page_id % 7 = 0 THEN 'kept' WHEN page_id % 7 = 1 THEN '' END AS cached FROM pages)"


@query(f"""SELECT page_id, name, CASE WHEN cached <> '' THEN cached ELSE category_id END AS category_id, CASE WHEN cached <> '' THEN NULL ELSE category END AS category, CASE WHEN cached <> '' THEN 1 ELSE tier END AS tier,
CASE WHEN coalesce(nullif(cached, ''), category_id) IS NULL THEN 'no category fits ' || name END AS error FROM (
SELECT w.page_id, w.name, w.cached, c.category, c.category_id, c.tier, row_number() OVER (PARTITION BY w.page_id ORDER BY c.tier NULLS LAST, c.pos) AS n FROM {_WANTED} w LEFT JOIN (
SELECT c.*, CASE WHEN c.category = w.name THEN 2 WHEN contains(c.category, w.name) OR contains(w.name, c.category) THEN 3 WHEN contains(c.category, 'council') THEN 4 END AS tier FROM {_WORDS} c JOIN {_WANTED} w ON w.page_id = c.page_id
) c ON c.page_id = w.page_id AND c.tier IS NOT NULL) WHERE n = 1""")
def category_tiers(spark, sf_dir):
    return H.cascaded_categories(*_menus(spark, sf_dir)).withColumnRenamed("source", "page_id")


@query(f"""SELECT page_id, category, category_id FROM (SELECT p.page_id, c.category, c.category_id, row_number() OVER (PARTITION BY p.page_id ORDER BY c.tier NULLS LAST, c.pos) AS n FROM (SELECT DISTINCT page_id FROM {_WORDS}) p LEFT JOIN (
SELECT c.*, CASE WHEN c.category = w.name THEN 1 WHEN contains(c.category, w.name) OR contains(w.name, c.category) THEN 2 WHEN contains(c.category, 'council') THEN 3 END AS tier FROM {_WORDS} c JOIN {_WANTED} w ON w.page_id = c.page_id
) c ON c.page_id = p.page_id AND c.tier IS NOT NULL) WHERE n = 1""")
def category_cascade(spark, sf_dir):
    wanted, found = _menus(spark, sf_dir)
    return H.resolved_category(found.withColumnRenamed("source", "page_id").join(wanted.select(F.col("source").alias("page_id"), "name"), "page_id"), F.col("name")).select("page_id", "category", "category_id")


def _digests(spark, sf_dir):
    """A digest of each document: every second lacks its title line, and so does not reach the second tier."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "# City digest\n\n").otherwise(""), F.lit("## Overview\n\n"), F.substring_index(F.regexp_replace("text", r"[\r\n#*!$\-]+", " "), " ", 12))
    return d.select(F.col("doc_id").cast("string").alias("text_id"), text.alias("text"), F.array().cast("array<string>").alias("known_item_numbers"), F.expr("cast(array() as array<struct<raw_name:string,role:string>>)").alias("people"), F.col("lang").alias("facts_block"))


def _judge(request: str) -> str:
    import json

    facts = json.loads(request)["facts"]
    if facts == "de":
        raise ValueError("refused")
    found = [("voice_register", "low", "Not its voice.", None)] if facts == "fr" else [("unsupported_claim", "medium", "No fact says so.", None), ("other", "low", "", None)] if facts == "es" else []
    return json.dumps([dict(zip(("rule", "severity", "message", "excerpt"), f)) for f in found])


_JUDGED = """(SELECT CAST(doc_id AS VARCHAR) AS text_id, CASE WHEN doc_id % 2 <> 0 THEN 'missing_header' WHEN lang = 'fr' THEN 'voice_register' WHEN lang = 'es' THEN 'unsupported_claim' END AS rule FROM documents)"""


@query(f"SELECT text_id, rule, CASE WHEN rule = 'missing_header' THEN 'rules' ELSE 'judge' END AS tier FROM {_JUDGED} WHERE rule IS NOT NULL")
def two_tiers(spark, sf_dir):
    found = Y.both_tiers(_digests(spark, sf_dir), N.KeyedStore(spark, S.new_path(spark, "judged")), _judge)
    return found.where(F.col("rule").isin("missing_header", *Y.C.JUDGE_RULES)).select("text_id", "rule", "tier")


@query(f"""SELECT tier, rule, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall FROM (
SELECT CASE WHEN rule = 'missing_header' THEN 'rules' ELSE 'judge' END AS tier, rule, count(*) FILTER (w AND f) AS tp, count(*) FILTER (f AND NOT w) AS fp, count(*) FILTER (w AND NOT f) AS fn FROM (
SELECT text_id, rule, bool_or(s = 'w') AS w, bool_or(s = 'f') AS f FROM (SELECT text_id, rule, 'f' AS s FROM {_JUDGED} WHERE rule IS NOT NULL
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN 'missing_header' ELSE 'voice_register' END, 'w' FROM documents) GROUP BY 1, 2) GROUP BY 1, 2)""")
def style_case_scores(spark, sf_dir):
    digests = _digests(spark, sf_dir)
    expected = digests.select("text_id", F.array(F.when(F.col("text_id").cast("long") % 3 == 0, "missing_header").otherwise("voice_register")).alias("expected"))
    found = Y.both_tiers(digests, N.KeyedStore(spark, S.new_path(spark, "judged")), _judge).where(F.col("rule").isin("missing_header", *Y.C.JUDGE_RULES))
    return Y.style_case_scores(expected, found).select("tier", "rule", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])
