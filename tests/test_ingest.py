import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import containment, schemas, style
from ledgerline.sources import connectors, html, isolated, snapshots, store

# ---- pager, connectors ------------------------------------------------------------------------------------

PAGES = "search string, url string, next_url string, is_first boolean"


def test_pager_follows_links_to_the_end(spark):
    rows = [("long", f"u{i}", f"u{i + 1}", i == 0) for i in range(300)]  # the last link leads nowhere
    rows += [("cycle", "a", "b", True), ("cycle", "b", "c", False), ("cycle", "c", "b", False), ("cycle", "lost", "a", False)]
    rows += [("self", "s", "s", True), ("single", "x", None, True), ("gap", "g0", "g1", True), ("gap", "g2", None, False), ("headless", "h0", "h1", False), ("twice", "t0", "t1", True), ("twice", "t0", "t1", True), ("twice", "t1", "", False)]
    got = {(r.search, r.url): r.page_no for r in connectors.paged(spark.createDataFrame(rows, PAGES), ["search"]).collect()}
    want = {("long", f"u{i}"): i + 1 for i in range(300)} | {("cycle", "a"): 1, ("cycle", "b"): 2, ("cycle", "c"): 3, ("self", "s"): 1, ("single", "x"): 1, ("gap", "g0"): 1, ("twice", "t0"): 1, ("twice", "t1"): 2}
    assert got == want
    assert connectors.paged(spark.createDataFrame([], PAGES), ["search"]).count() == 0


GRID = '<table id="a_gridCalendar_ctl00"><tr><th class="rgHeader">Name</th><th class="rgHeader">Meeting Date</th><th class="rgHeader">Agenda</th></tr><tr><td>{0}</td><td>1/{1}/2026</td><td><a href="A{1}.pdf">a</a></td></tr><tr><td>&nbsp;</td><td></td><td></td></tr></table>'
CENTER = '<table><tr class="catAgendaRow"><td><strong aria-label="Agenda for May {1}, 2025"></strong><a href="/AgendaCenter/ViewFile/Agenda/_{1}">Agenda for May 6, 2025 {0}</a></td><td class="minutes x"><a href="M">m</a></td></tr><tr class="catAgendaRow"><td>none</td></tr></table>'


def landed(spark, page, kind):
    rows = [(kind, f"city{c}", period, asked, n + 1, "https://x.org/", page.format(f"Board {c}", n)) for c in range(3) for period in ("this month", "last/year: 1") for asked in ("City Council", None) for n in range(5)]
    path = store.new_path(spark, "landed")
    connectors.land(spark.createDataFrame(rows, "connector string, source string, period string, asked string, page_no int, base string, html string"), path)
    return path


@pytest.mark.parametrize("kind,page,native", [("legistar", GRID, html.calendar_meetings), ("civicplus", CENTER, html.agenda_center_meetings)])
def test_a_source_gives_what_the_native_operators_give(spark, kind, page, native):
    path = landed(spark, page, kind)
    got = connectors.meetings(spark, kind, path)
    pages = spark.read.parquet(path).withColumn("page_no", F.col("page_no").cast("long"))
    want = native(html.parsed_pages(pages), F.col("asked"), F.col("base"), None, ("source", "period", "asked", "page_no"))
    names = [c for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*[want[c].cast(got.schema[c].dataType) for c in names]).collect())) and got.count() >= 60
    first = connectors.meetings(spark, kind, path, source="city1", limit=2).collect()
    assert len(first) == 8 and {r.page_no for r in first} <= {1, 2}
    assert spark.read.format(kind).option("path", store.new_path(spark, "none")).load().count() == 0


def test_filters_are_pushed(spark):
    path = landed(spark, GRID, "legistar")
    connectors.register(spark, push_filters=True)
    load = lambda: spark.read.format("legistar").option("path", path).option("push_filters", "true").load()  # noqa: E731  anew for each query
    asked = load().where("period = 'last/year: 1' AND source IN ('city0', 'city2') AND asked LIKE '%Council' AND date != ''")
    assert asked.rdd.getNumPartitions() == 2 and load().rdd.getNumPartitions() == 12
    plan = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [EqualTo(period,last/year: 1), In(source, [city0,city2]), StringEndsWith(asked,Council)]" in plan
    unpushed = load().where(F.concat("period", F.lit("")) == "last/year: 1").where(F.concat("source", F.lit("")).isin("city0", "city2")).where(F.concat("asked", F.lit("")).contains("Council")).where("date != ''")
    assert Counter(map(tuple, asked.collect())) == Counter(map(tuple, unpushed.collect())) and asked.count() == 10
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert connectors.meetings(spark, "legistar", path, source="city1", body="Council").rdd.getNumPartitions() >= 1
    reader = connectors.PushingReader("legistar", path)
    from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("period",), "this month"), EqualNullSafe(("asked",), None), GreaterThan(("page_no",), 3)]))
    assert [type(f) for f in left] == [GreaterThan] and len(reader.partitions()) == 3 and all(p.values["asked"] is None for p in reader.partitions())


def test_reads_are_tried_again():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("slow store")
        return "done"

    assert connectors.tried(work, pause=0) == "done" and len(calls) == 3
    with pytest.raises(OSError):
        connectors.tried(lambda: (_ for _ in ()).throw(OSError("gone")), pause=0)
    with pytest.raises(FileNotFoundError):
        connectors.tried(lambda: open("/none/such"), pause=100)


def test_titles_by_row_and_by_column_agree(spark):
    titles = ["Agenda for the May 6, 2025 City Council Meeting.", "agenda FOR May 6, 2025 Planning  Commission meeting", "Agenda for May 6, 2025 Meeting", "Agenda for May 6, 2025", "Agenda for May six, 2025 X", "The Agenda for the The 6, 2025 X", "Packet", "", "Agenda for", "Re: Agenda for June 1, 2024 Board of Z Meeting Meeting"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select("t", html.body_of_title(F.col("t"), F.lit("f")).alias("body"))
    for r in df.collect():
        assert r.body == (connectors.agenda_body(r.t) or "f"), r.t
    assert [connectors.agenda_body(t) for t in titles[:4]] == ["City Council", "Planning Commission", "Meeting", None]


def test_registered_readers_read_by_entry(spark):
    from ledgerline.sources import registry

    path = landed(spark, GRID, "legistar")
    rows = registry.reader_of({"connector": "legistar"})(spark, {"name": "city2", "landed": path, "body": "Council"}, "this month", None, 1).collect()
    assert len(rows) == 1 and rows[0].body == "Board 2" and rows[0].agenda_url == "https://x.org/A0.pdf"
    with pytest.raises(ValueError):
        registry.reader_of({"connector": "gopher"})


# ---- stores ------------------------------------------------------------------------------------------------


def test_answers_are_asked_for_once(spark):
    kept = snapshots.KeyedStore(spark, store.new_path(spark, "answers"))
    asked = spark.createDataFrame([("v", "m", f"r{i % 7}") for i in range(60)], "prompt_version string, model string, request string").repartition(4)
    calls = spark.sparkContext.accumulator(0)

    def provider(request):
        calls.add(1)
        if request == "r3":
            raise ValueError
        return request * 2

    def answers():
        return {r.request: r.response for r in snapshots.answered(asked, kept, provider).collect()}

    want = {f"r{i}": None if i == 3 else f"r{i}r{i}" for i in range(7)}
    assert answers() == want and calls.value == 7
    assert answers() == want and calls.value == 8  # only the refused one again
    assert kept.read().count() == 6


def test_side_by_side_appends_leave_one_row_a_key(spark):
    root = store.new_path(spark, "keyed")
    one, two = snapshots.KeyedStore(spark, root), snapshots.KeyedStore(spark, root)
    assert one.read().count() == 0
    rows = lambda tag, keys: spark.createDataFrame([(k, f"{tag}{k}") for k in keys], "key string, response string")
    one.append(rows("one", "abc"))
    two.append(rows("two", "bcd"))
    assert {r.key: r.response for r in two.read().collect()} == {"a": "onea", "b": "oneb", "c": "onec", "d": "twod"}
    rows("half", "xyz").write.parquet(f"{root}/batches/00-half")  # a batch whose commit never came
    one.files._fs.delete(one.files._path("batches/00-half/_SUCCESS"), False)
    assert one.read().count() == 4


def test_snapshots_swap_and_conflict(spark):
    root = store.new_path(spark, "snap")
    a, b = snapshots.Snapshots(spark, root), snapshots.Snapshots(spark, root)
    with pytest.raises(LookupError):
        a.read()
    assert a.replace(spark.range(3)) == 1 and b.version() == 1
    assert a.replace(spark.range(5)) == 2 and b.read().count() == 5 and b.read(1).count() == 3
    with pytest.raises(snapshots.Conflict):
        b.replace(spark.range(9), expected=1)
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        a.replace(broken)
    assert a.version() == 2 and a.read().count() == 5  # a failure half-way leaves the old version
    a.files.create("versions/000000000003", "")  # a writer that has not ended its pointer
    assert b.version() == 2 and b.read().count() == 5
    tries = []

    def slow(now):
        tries.append(now.count())
        if len(tries) == 1:
            snapshots.Snapshots(spark, other).replace(spark.range(8))
        return now.limit(1)

    other = store.new_path(spark, "snap")
    c = snapshots.Snapshots(spark, other)
    c.replace(spark.range(6))
    assert c.change(slow) == 3 and tries == [6, 8] and c.read().count() == 1


def test_scorecards_and_baseline(spark):
    cards = snapshots.Scorecards(spark, store.new_path(spark, "cards"))
    card = lambda f1, suite="s": {"suite": suite, "fields": {"people": {"f1": f1}, "amounts": {"f1": 0.9}}}
    assert cards.load("s") is None and cards.fields("s", "baseline").count() == 0
    cards.save(card(0.8), promote=True)
    cards.save(card(0.7))
    cards.save(card(0.1, "t"))
    assert cards.load("s")["fields"]["people"]["f1"] == 0.7 and cards.load("s", "baseline")["fields"]["people"]["f1"] == 0.8
    from ledgerline.operators import scoring

    worse = scoring.regressions(cards.fields("s", "latest"), cards.fields("s", "baseline")).collect()
    assert [(r.field_type, round(r.delta, 6)) for r in worse] == [("people", -0.1)]


# ---- isolation ---------------------------------------------------------------------------------------------


def test_one_failing_source_stops_no_other(spark):
    def reader(kind, page, asked, base):
        if kind == "late":
            yield {"pos": 0, "body": "b", "date": "1/1/2026"}
            raise RuntimeError("half-way" * 50)
        yield from isolated.read_page(kind, page, asked, base)

    rows = [(i, f"s{i % 5}", "late" if i in (3, 8) else "legistar", "Asked", "https://x.org/", GRID.format("B", i) if i % 5 != 1 else None) for i in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, source string, connector string, asked string, base string, html string").repartition(3)
    out = isolated.ingest(pages, reader)
    assert out.counts == {"pages": 15, "failed": 2, "meetings": 20}
    assert {(r.source, r.pages, r.page_id) for r in out.errors.collect()} == {("s3", 2, 3)}
    assert out.errors.first().error.startswith("RuntimeError: half-way") and len(out.errors.first().error) == isolated.ERROR_CHARS
    assert Counter(r.source for r in out.meetings.collect()) == {"s0": 6, "s2": 6, "s4": 6}
    assert {r.source: r.status for r in out.sources.collect()} == {"s0": "ok", "s1": "empty", "s2": "ok", "s3": "error", "s4": "ok"}


# ---- schemas, categories, style ------------------------------------------------------------------------------


def test_schema_differences_by_path(spark):
    old = T.StructType().add("a", "integer", False).add("b", T.ArrayType(T.StructType().add("x", "string").add("y", "long"))).add("m", T.MapType(T.StringType(), T.DoubleType())).add("gone", T.StructType().add("in", "integer"))
    new = T.StructType().add("a", "integer", True).add("b", T.ArrayType(T.StructType().add("x", "string").add("y", "integer").add("z", "date"))).add("m", T.MapType(T.StringType(), T.DoubleType())).add("came", "boolean")
    rows = schemas.differences(schemas.as_table(spark, old), schemas.as_table(spark, new)).collect()
    assert {tuple(r) for r in rows} == {
        ("a", "optional", "int", "int"), ("b[].y", "retyped", "bigint", "int"), ("b[].z", "added", None, "date"), ("gone", "removed", "struct", None), ("gone.in", "removed", "int", None), ("came", "added", None, "boolean"),
    }
    assert schemas.check_document(spark, old.json(), old) == []
    assert "retyped: b[].y (bigint -> int)" in schemas.check_document(spark, json.dumps(old.jsonValue()), new)


def test_categories_by_tier(spark):
    found = [("a", 0, "planning", "1"), ("a", 1, "city council", "2"), ("a", 2, "council of elders", "3"), ("b", 0, "parks", "9"), ("c", 0, "the town council board", "5"), ("d", 0, "board of x", "6"), ("d", 1, "board", "7")]
    wanted = [("a", "City Council", None), ("a", "Council", ""), ("a", "Zoning", None), ("b", "Zoning", None), ("b", "Zoning", "77"), ("c", "Town Council", None), ("d", "Board", None), ("none", "X", None), ("b", None, None)]
    got = html.cascaded_categories(spark.createDataFrame(wanted, "source string, name string, cached_id string"), spark.createDataFrame(found, "source string, pos int, category string, category_id string"))
    rows = Counter((r.source, r.name, r.category_id, r.tier, r.error) for r in got.collect())
    assert rows == Counter([
        ("a", "city council", "2", 2, None), ("a", "council", "2", 3, None), ("a", "zoning", "2", 4, None), ("b", "zoning", None, None, "no category fits zoning"), ("b", "zoning", "77", 1, None), ("c", "town council", "5", 3, None),
        ("d", "board", "7", 2, None), ("none", "x", None, None, "no category fits x"), ("b", None, None, None, "no category fits nothing"),
    ])


def test_the_second_tier_sees_only_what_passes_the_first(spark):
    texts = spark.createDataFrame(
        [("good", "# T\n\n## Overview\n\nOne thing was heard.", [], [], "f1"), ("same", "# T\n\n## Overview\n\nOne thing was heard.", [], [], "f1"), ("bad", "no title", [], [], "f2")],
        "text_id string, text string, known_item_numbers array<string>, people array<struct<raw_name:string,role:string>>, facts_block string",
    )
    calls = spark.sparkContext.accumulator(0)

    def provider(request):
        calls.add(1)
        assert json.loads(request)["facts"] == "f1"
        return json.dumps([{"rule": "editorializing", "severity": "low", "message": "m", "excerpt": None}, {"rule": "made_up", "severity": "low", "message": "", "excerpt": ""}])

    kept = snapshots.KeyedStore(spark, store.new_path(spark, "judged"))
    for _ in range(2):
        found = {(r.text_id, r.rule, r.tier) for r in style.both_tiers(texts, kept, provider).collect()}
        assert {x for x in found if x[2] == "judge"} == {("good", "editorializing", "judge"), ("same", "editorializing", "judge")}
        assert {x[0] for x in found if x[1] == "missing_header"} == {"bad"}
    assert calls.value == 1
    cases = spark.createDataFrame([("good", ["editorializing", "voice_register"]), ("same", []), ("bad", ["missing_header", "missing_overview"])], "text_id string, expected array<string>")
    scores = {r.rule: (r.tier, r.tp, r.fp, r.fn) for r in style.style_case_scores(cases, style.both_tiers(texts, kept, provider)).collect()}
    assert scores == {"editorializing": ("judge", 1, 1, 0), "voice_register": ("judge", 0, 0, 1), "missing_header": ("rules", 1, 0, 0), "missing_overview": ("rules", 1, 0, 0)}


# ---- containment ---------------------------------------------------------------------------------------------


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "cab", "x-y", "é1", "..", "the", "日本語", "the\tend"]
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", " ", "ab"]
    spans = ["", " ", "  ", "\n", "a", "ab c", "b", "cab the", " ab ", "zzz", "the the the", "日", "語 日", ". x", "ab\n"]
    for _ in range(120):
        t = rng.choice(texts)
        if t:
            a = rng.randrange(len(t))
            spans.append(t[a : a + rng.randrange(1, 25)])
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string").withColumn("item_id", F.lit(1))
    asked = spark.createDataFrame([*enumerate(spans), (1000, None)], "item_id long, source_text string").withColumn("text", F.lit("x"))
    got = {tuple(r) for r in containment.contained(docs, asked).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, s in enumerate(spans) if s in t}
    plan = containment.contained(docs, asked.where("source_text != ''"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.contained(docs.limit(0), asked).count() == 0 and containment.contained(docs, asked.limit(0)).count() == 0
