import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.plans import pipeline
from ledgerline.sources import documents as D
from ledgerline.sources import html as H
from ledgerline.sources import registry as R
from ledgerline.sources import store

CALENDAR = """<html><title> Cal &amp; Co </title><table id="x_gridCalendar_ctl00">
<tr class="rgPager"><th>pages</th></tr>
<tr><th class="rgHeader">Name</th><th class="rgHeader">Meeting Date</th><th class="rgHeader">Meeting&nbsp;Time</th><th class="rgHeader" colspan="2">Meeting Details</th><th class="rgHeader">Agenda</th><th class="rgHeader">Video</th></tr>
<tr><td>City Council</td><td>1/9/2026</td><td>9:00</td><td><a href="MeetingDetail.aspx?ID=1">d</a></td><td></td><td><a href="#" onclick="window.open('View.ashx?M=A&amp;ID=1', 'x')">a</a></td><td><a href="#">v</a></td></tr>
<tr><td></td><td></td><td></td><td></td><td></td><td></td><td></td></tr>
<tr><td>Third</td><td>3/3/2026</td></tr>
<tr class="rgPager"><td>1 2 3</td></tr></table></html>"""
AGENDA = """<table id="a_gridMain_ctl00"><tr><th>File #</th><th>Ver.</th><th>Title</th><th>Type</th></tr>
<tr><td><a href="LegislationDetail.aspx?ID=7">26-1</a></td><td>1</td><td> Fix it </td><td>Consent Agenda</td></tr>
<tr><td><a href="Other.aspx">26-2</a></td><td>1</td><td>No link</td><td></td></tr>
<tr><td><a href="LegislationDetail.aspx?ID=8">26-3</a></td><td>1</td><td></td><td></td></tr></table>
<span id="ctl_lblStatus2">Passed</span><span id="ctl_lblDescription2">Some text</span>
<a href="View.ashx?M=F&ID=1">Memo</a><a href="View.ashx?M=F&ID=1">Memo again</a><a href="/Documents/2"></a><a href="/about">x</a>"""
CENTER = """<input type="checkbox" id="c1" value="11"><label for="c1">City Council</label><input type="checkbox" id="c2" value="12">
<table><tr class="catAgendaRow"><td><h3><strong aria-label="Agenda for May 6, 2025">May 6</strong></h3><p><a href="/AgendaCenter/ViewFile/Agenda/_05062025-1">Agenda for the May 6, 2025 City Council Meeting.</a></p></td>
<td class="minutes"><a href="/AgendaCenter/ViewFile/Minutes/_05062025-1">m</a></td><td class="media"></td></tr><tr class="catAgendaRow"><td>no label</td></tr></table>"""


def pages(spark, *htmls):
    return H.parsed_pages(spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string"))


def test_calendar(spark):
    df = pages(spark, CALENDAR, None, "<table><tr><td>unclosed")
    assert df.first().page.title == "Cal & Co"
    rows = H.calendar_meetings(df, F.lit("Asked Body"), F.lit("https://x.org/")).orderBy("pos").collect()
    assert [(r.body, r.date) for r in rows] == [("City Council", "1/9/2026"), ("Asked Body", ""), ("Third", "3/3/2026")]
    a = rows[0]
    assert (a.time, a.meeting_details_url, a.agenda_url, a.minutes_url, a.video_url) == ("9:00", "https://x.org/MeetingDetail.aspx?ID=1", "https://x.org/View.ashx?M=A&ID=1", None, None)
    assert H.calendar_meetings(df, F.lit("b"), F.lit("https://x.org/"), limit=1).count() == 1
    none = CALENDAR.replace("Meeting Date", "When")
    assert H.calendar_meetings(pages(spark, none), F.lit("b"), F.lit("")).count() == 0


def test_agenda_and_legislation(spark):
    df = pages(spark, AGENDA)
    rows = H.agenda_entries(df, F.lit("https://x.org/")).collect()
    assert [(r.file_number, r.title, r.legislation_url) for r in rows] == [("26-1", "Fix it", "https://x.org/LegislationDetail.aspx?ID=7")]
    d = H.legislation_details(df).first()
    assert (d.status, d.text, d.recommendations) == ("Passed", "Some text", None)
    assert [(r.name, r.url) for r in H.attachments(df, F.lit("https://x.org/")).collect()] == [("Memo", "https://x.org/View.ashx?M=F&ID=1")]


def test_agenda_center_and_categories(spark):
    df = pages(spark, CENTER)
    r = H.agenda_center_meetings(df, F.lit("Fallback"), F.lit("https://c.org")).first()
    assert (r.body, r.date, r.meeting_details_url) == ("City Council", "May 6, 2025", "https://c.org/AgendaCenter/ViewFile/Agenda/_05062025-1")
    assert r.agenda_url == r.meeting_details_url and r.minutes_url.endswith("Minutes/_05062025-1") and r.video_url is None
    found = H.categories(df)
    assert [(x.category, x.category_id) for x in found.collect()] == [("city council", "11")]
    assert H.resolved_category(found, F.lit("Council")).first().category_id == "11" and H.resolved_category(found, F.lit("Parks")).first().category_id == "11"
    titles = ["Agenda for the May 6, 2025 City Council Meeting.", "Agenda for May 6, 2025 Planning Commission Meeting.", "Agenda for the May 6, 2025 City Council Meeting", "Agenda for May 6, 2025 Planning Commission", "Packet.pdf", "2025 City Council Meeting", ""]
    row = spark.range(1).select(*[H.body_of_title(F.lit(t), F.lit("f")).alias(f"t{i}") for i, t in enumerate(titles)]).first()
    assert tuple(row) == ("City Council", "Planning Commission", "City Council", "Planning Commission", "f", "f", "f")


def test_odd_markup(spark):
    grid = '<table id="gridCalendar_ctl00"><tr><th colspan="{}">Meeting Date</th><th>Name</th></tr><tr><td>1/2/2026</td><td>x</td></tr></table>'
    for span in ("\u00b2", "0", "-1", "x", "", "1", "9" * 30):
        df = pages(spark, grid.format(span), "<p id=\"a_lblStatus2\">no</p><span id=\"b_lblStatus2\">Passed</span><span id=\"c_lblActionText2\">Adopt</span>")
        rows = H.calendar_meetings(df, F.lit("b"), F.lit("https://x.org/")).collect()
        assert [(r.date, r.body) for r in rows] == [("1/2/2026", "x")], span
    assert len(spark.range(1).select(F.lit(1)).collect()) == 1 and pages(spark, grid.format(10**9)).first().page.grids[0].rows[0].cells[0].span == 1000
    d = H.legislation_details(df).where("page_id = 1").first()
    assert (d.status, d.recommendations) == ("Passed", "Adopt")


def test_documents(spark, tmp_path):
    wanted = D.requests(spark.createDataFrame([("http://a/x.pdf", "San Jose"), ("http://a/y", "San Jose"), ("http://a/x.pdf", "San Jose")], "url string, jurisdiction string"))
    stored = wanted.where("url LIKE '%y'")
    todo = D.missing(wanted, stored).collect()
    assert len(todo) == 1 and todo[0].path.startswith("san-jose/") and todo[0].path.endswith(".pdf") and len(todo[0].address) == 16
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    rows = {r.path[-5:]: r for r in D.read_files(spark, str(tmp_path)).collect()}
    assert rows["b.PDF"].ocr_required and not rows["a.txt"].ocr_required
    rows = {r.path[-5:]: r for r in D.read_files(spark, str(tmp_path), lambda b: ("words " * 20, 1)).collect()}
    assert not rows["b.PDF"].ocr_required
    flags = spark.range(1).select(D.ocr_required(F.lit("  "), F.lit(1)), D.ocr_required(F.lit(""), F.lit(0)), D.ocr_required(F.lit("x" * 20), F.lit(1))).first()
    assert tuple(flags) == (True, False, False)


def test_sections(spark):
    text = "intro\nBACKGROUND\nold times\n  Fiscal Impact:  \n$5\nBackground\nnew times\n"
    row = spark.createDataFrame([(text,)], "t string").select(D.sections(F.col("t")).alias("s")).select("s", D.report_text(F.col("s")).alias("r")).first()
    assert row.s["BACKGROUND"] == "new times" and row.s["FISCAL IMPACT"] == "$5" and row.s["_full_text"] == text
    assert row.r == "=== BACKGROUND ===\nnew times\n\n=== FISCAL IMPACT ===\n$5"
    bare = spark.createDataFrame([("no sections",)], "t string").select(D.report_text(D.sections(F.col("t")))).first()[0]
    assert bare == "no sections"


def test_choices(spark):
    shape = "jurisdiction string, period string, date string, pos int, meeting_details_url string, minutes_url string, agenda_url string, entries array<string>"
    m = spark.createDataFrame([("a", "now", "1/1/2026", 0, "", "", "u", []), ("a", "past", "11/1/2026", 1, "d", "m", "u", ["e"]), ("b", "now", "2/2/2026", 0, "d", None, "", ["e"])], shape)
    assert {(r.jurisdiction, r.period) for r in D.with_fallback_period(m, "now", "past").collect()} == {("a", "past"), ("b", "now")}
    assert [r.date for r in D.selected_meetings(m, "1/1/2026").collect()] == ["11/1/2026"]
    assert [r[0] for r in m.orderBy("jurisdiction", "pos").select(D.chosen_url()).collect()] == ["u", "m", None]
    assert D.first_with_agenda(m).count() == 2


def test_registry(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("- {name: San Jose, homepage: 'https://sj.org', platform: legistar, connector: legistar, legistar_url: 'https://sj.legistar.com/Calendar.aspx'}\n- {name: Elsewhere, homepage: 'https://e.org'}\n- {name: Third, connector: civicplus}\n")
    cities = R.load_registry(spark, str(tmp_path / "c.yaml"))
    assert [r.name for r in R.active(cities, limit=1).collect()] == ["San Jose"] and R.active(cities, "civicplus", "THI").count() == 1
    assert R.of_platform(cities).first().body == "City Council" and R.the_one(cities.where("name = 'Third'"), "city")["name"] == "Third"
    with pytest.raises(LookupError):
        R.the_one(cities, "city")
    with pytest.raises(ValueError):
        R.reader_of({"connector": "nope"})
    new = R.merged(cities, spark.createDataFrame([("Elsewhere", "granicus")], "name string, platform string"), ["platform"]).collect()
    assert [r.platform for r in new] == ["legistar", "granicus", None]
    (tmp_path / "s.csv").write_text("A,http://a.org,https://a.legistar.com/x?y=1,2\nB\n")
    seeded = {r.name: r for r in R.seeded(spark, str(tmp_path / "s.csv"), spark.createDataFrame([("B", "http://b.org", None)], "name string, homepage string, agenda_url string")).collect()}
    assert seeded["A"].agenda_url.endswith("1,2") and seeded["A"].root_url == "https://a.legistar.com/Calendar.aspx" and seeded["B"].homepage == "http://b.org"
    probes = spark.createDataFrame([("a", "https://x", "see granicus.com", False), ("b", "https://x", "", True), ("c", "https://x", None, False)], "name string, final_url string, html string, reached boolean")
    assert {r.name: r.platform for r in R.detected(probes).collect()} == {"a": "granicus", "b": "legistar", "c": None}
    p = spark.createDataFrame([("a", "https://a.org/x", "e" * 200, False, None), ("b", "https://a.org", None, True, None), ("c", "https://a.org", None, True, "cc")], "name string, homepage string, error string, has_center boolean, category string")
    rows = {r.name: r for r in R.probe_status(p).collect()}
    assert (rows["a"].status, len(rows["a"].note), rows["b"].status, rows["c"].status) == ("error", 120, "no_council_category", "ok")
    assert R.pending(cities).count() == 3 and R.counted(cities, "connector").count() == 3


def test_stores_and_response_cache(spark, tmp_path):
    runs = spark.createDataFrame([Row(jurisdiction=" San Jose", generated_at="2"), Row(jurisdiction="San Jose ", generated_at="1")])
    store.append_run(runs, str(tmp_path / "runs"))
    shape = "jurisdiction string, generated_at string, city_slug string"
    assert [r.generated_at for r in store.run_history(spark, str(tmp_path / "runs"), shape, "San Jose").collect()] == ["1", "2"]
    assert store.read_or_empty(spark, str(tmp_path / "nothing"), shape).count() == 0
    m = spark.createDataFrame([("San Jose", "p", 1), ("Oak", "p", 2)], "jurisdiction string, period_label string, x int")
    store.write_by_city(m, str(tmp_path / "m"), "period_label")
    store.write_by_city(m.where("x = 2").withColumn("x", F.lit(3)), str(tmp_path / "m"), "period_label")
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 3]
    (tmp_path / "cases").mkdir()
    with pytest.raises(LookupError):
        store.read_cases(spark, str(tmp_path / "cases"), "id string")
    (tmp_path / "cases" / "b.json").write_text('{"id": "b",\n"x": 1}')
    assert store.read_cases(spark, str(tmp_path / "cases"), "id string").first().file == "b.json"
    asks = spark.createDataFrame([("v", "m", "1"), ("v", "m", "1"), ("v", "m", "2")], "prompt_version string, model string, request string")
    cache = spark.createDataFrame([], "key string, response string")
    out, made = store.answered(asks, cache, lambda r: r * 2)
    assert sorted(r.response for r in out.collect()) == ["11", "11", "22"] and made.count() == 2
    again, none = store.answered(asks, made, lambda r: 1 / 0)
    assert none.count() == 0 and again.count() == 3


def test_ingest(spark):
    p = spark.createDataFrame([("SJ", "now", "<table></table>"), ("SJ", "past", CALENDAR), ("CP", "now", CENTER), ("Bad", "now", None)], "jurisdiction string, period string, html string")
    c = spark.createDataFrame([(0, "SJ", "legistar", None, "https://sj.legistar.com/Calendar.aspx"), (1, "CP", "civicplus", None, "https://c.org"), (2, "Bad", "legistar", None, "https://b.org")], "pos int, name string, connector string, body string, root_url string")
    found = pipeline.ingest(p, c, "now", "past")
    assert {r.jurisdiction: r["count"] for r in found.groupBy("jurisdiction").count().collect()} == {"SJ": 3, "CP": 1}
    assert found.where("jurisdiction = 'SJ' AND pos = 2").first().meeting_details_url == "https://sj.legistar.com/MeetingDetail.aspx?ID=1"
    assert {r.jurisdiction: r.status for r in pipeline.city_status(c, found).collect()} == {"SJ": "ok", "CP": "ok", "Bad": "empty"}


def test_title_as_the_source_spells_it(spark):
    pages = {"<title>a &amp;&amp;&amp</title>": "a &&&amp", "<title lang='x'> a \n b&#39;s </title><title>c</title>": "a b's", "<p>": "", None: None}
    df = spark.createDataFrame(list(pages.items()), "html string, want string").select(H.source_title(F.col("html")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
