import difflib
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions import similarity as S
from ledgerline.functions import text as T
from ledgerline.functions import urls as U
from ledgerline.operators import style
from ledgerline.plans import fixtures

TEXTS = ["", None, "Ordinance No. 31328 was read (Item 2.2). It passed! Did it? Yes.", "# Head\n\nOne line. Two  lines here.\n\n## Sub\nText below.", "Mr. Smith vs. Co. Inc. met St. John Ave. early. Done.", "tide", "a\n\n# x\ny\n\nb c", "One. Two!\r\n\t# Head\r\nThree.\x0bFour?\u2028 Five. \x1f\x85Six.\t"]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text", TEXTS)
def test_against_plain_python(spark, text):
    t = F.col("t")
    row = one(spark, text, T.normalize(t).alias("n"), T.sentences(t).alias("s"), T.word_count(t).alias("w"), T.paragraphs(t).alias("p"), T.headings(t).alias("h"))
    plain = text or ""
    assert row.n == " ".join(plain.lower().split()) and row.w == len(plain.split())
    look = "".join(rf"(?<!\b{a}\.)" for a in C.ABBREVIATIONS)
    lines = [x.strip() for x in plain.splitlines()]
    assert row.s == [s for x in lines if x and not x.startswith("#") for s in re.split(rf"(?<=[.!?]){look}\s+", x) if s]
    assert row.p == [p.strip() for p in plain.split("\n\n") if p.strip() and not p.strip().startswith("#")]
    assert row.h == re.findall(r"^##\s+(.+?)\s*$", plain, re.M)


def test_snippet_and_grade_word_by_word(spark):
    long = "\t\r\n " + "word\u3000" * 60 + "\x1f"
    got = one(spark, long, T.snippet(F.col("t")))[0]
    want = long.strip()
    assert got == (want if len(want) <= 120 else want[:120].rstrip() + "...")
    for text in [t for t in TEXTS if t] + ["e ee eve's 'e' aye queue eerie one-time TABLE Bee rhythm's x. Tse'e be."]:
        t = F.col("t")
        row = one(spark, text, T.reading_grade(t).alias("g"), F.transform(T.letter_words(t), T.syllables).alias("y"), F.size(T.sentences(t)).alias("s"))
        n = len(row.y)
        assert abs(row.g - (0.39 * n / row.s + 11.8 * sum(row.y) / n - 15.59 if n and row.s else 0.0)) < 1e-9, text


def test_syllables_grade_and_citations(spark):
    row = one(spark, "x", *[T.syllables(F.lit(w)).alias(w) for w in ("the", "agreement", "rhythm", "pcs")])
    assert list(row) == [1, 3, 1, 1]
    easy, hard, none = (one(spark, t, T.reading_grade(F.col("t")))[0] for t in ("The cat sat. The dog ran.", "Institutional reorganization necessitates comprehensive intergovernmental accountability.", ""))
    assert easy < 6 < 12 < hard and none == 0.0
    assert one(spark, "a (Item 2.1) b (Item  9.x)", T.citations(F.col("t")))[0] == ["2.1", "9.x"]
    assert one(spark, "# T\n## Overview\n$5 here\n## Rest\nok", T.without_overview(F.col("t")))[0] == "# T\n## Rest\nok"


def test_snippets_and_templates(spark):
    assert one(spark, "x" * 119 + " yy", T.snippet(F.col("t")))[0] == "x" * 119 + "..."
    doc = "a" * 100 + "SPAN" + "b" * 100
    assert one(spark, doc, T.context_snippet(F.col("t"), F.lit("SPAN")))[0] == "..." + "a" * 80 + "SPAN" + "b" * 80 + "..."
    assert one(spark, doc, T.context_snippet(F.col("t"), F.lit("none")))[0] == "none"
    assert one(spark, "{a} and {b}", T.fill_template(F.col("t"), {"a": F.lit("{b}"), "b": F.lit("2")}))[0] in ("2 and 2", "{b} and 2")
    assert one(spark, "doc", T.verified(F.lit(""), F.col("t")), T.verified(F.lit(None).cast("string"), F.col("t")))[:] == (True, False)


def test_urls(spark):
    u = F.col("t")
    row = one(spark, "https://x.org:81/a/Doc.PDF?q=1", U.extension(u).alias("e"), U.extension(u, F.lit("text/html; charset=x")).alias("m"), U.base_url(u).alias("b"), U.host(u).alias("h"), U.absolute(u, F.lit("../View.ashx?a=1")).alias("j"))
    assert tuple(row) == (".pdf", ".html", "https://x.org:81", "x.org", "https://x.org:81/View.ashx?a=1")
    start, end = U.month_range(F.lit("2024-02-10").cast("date"))
    assert tuple(one(spark, "x", start, end)) == ("02/01/2024", "02/29/2024")
    day = F.lit("2024-02-10").cast("date")
    urls = one(spark, "https://c.org", *[U.search_url(u, F.lit(p), F.lit("7"), day).alias(str(i)) for i, p in enumerate(["This Month", "last week", "ever", None])])
    assert "startDate=02/01/2024" in urls[0] and urls[1].endswith("dateSelector=1") and urls[2].endswith("=3") and urls[3].endswith("=3")
    dates = one(spark, "x", U.meeting_date(F.lit("1/9/2026")), U.meeting_date(F.lit("January 9, 2026")), U.meeting_date(F.lit("soon")))
    assert str(dates[0]) == str(dates[1]) == "2026-01-09" and dates[2] is None
    assert one(spark, "San José City", U.subdomain_slugs(u))[0][2].endswith("ca")


def test_similarity_equals_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), (None, ""), ("A  b", "a b"), ("motion to approve the plan", "motion to approve plan b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"))).collect()]
    plain = lambda x: " ".join((x or "").lower().split())
    assert got == [difflib.SequenceMatcher(None, plain(a), plain(b)).ratio() for a, b in pairs]
    assert [r[0] for r in df.select(S.at_least(F.col("a"), F.col("b"), 0.5)).collect()] == [x >= 0.5 for x in got]


def test_rules_on_fixture_texts(spark):
    found = style.check_deterministic(spark.createDataFrame(fixtures.DIGESTS, fixtures.DIGEST_SCHEMA))
    counts = {(r.text_id, r.rule, r.severity): r["count"] for r in found.groupBy("text_id", "rule", "severity").count().collect()}
    assert counts == {(a, b, c): n for a, b, c, n in fixtures.EXPECTED_FINDINGS}
    assert {r for _, r, _ in counts} == set(style.DETERMINISTIC_RULES)
    assert not style.passes(found) and style.passes(found.where("text_id = 'good'"))


def test_judge_tier_and_context(spark):
    texts = spark.createDataFrame([("1", "t", "f")], "text_id string, text string, facts_block string")
    rows = style.judged(texts, lambda t, f: [("editorializing", "low", "m", None), ("other", "low", "m", None)]).collect()
    assert [r.rule for r in rows] == ["editorializing"]
    items = spark.createDataFrame([("t", 0, "1", [("A B", "mayor")]), ("t", 1, "", [("A B", "staff"), ("C D", "staff")])], "text_id string, pos int, item_number string, people array<struct<raw_name:string,role:string>>")
    row = style.context_of(items).first()
    assert row.known_item_numbers == ["1"] and [tuple(p) for p in row.people] == [("A B", "mayor"), ("C D", "staff")]


def test_other_fixture_cases(spark):
    from ledgerline.functions import urls as U
    from ledgerline.operators import matching, scoring
    from ledgerline.sources import html as H

    found = spark.createDataFrame([(u,) for u in fixtures.URLS], "u string").select("u", U.platform(F.col("u"), F.lit(None).cast("string")).alias("p")).collect()
    assert [r.p for r in found] == ["legistar", "granicus", "civicplus", "iqm2", None]
    scores = scoring.rule_scores(spark.createDataFrame(fixtures.RULE_CASES, "expected array<string>, actual array<string>")).collect()
    assert {(r.rule, r.tp, r.fp, r.fn) for r in scores} == set(fixtures.RULE_COUNTS)
    amounts = spark.createDataFrame(fixtures.AMOUNTS, "a string, b string, want boolean").select(matching.amounts_equal(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in amounts)
    names = spark.createDataFrame(fixtures.NAMES, "name string, want string").select(matching.strip_title(F.col("name")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in names)
    gold, pred = (spark.createDataFrame(rows, "case_id string, field_type string, idx int, value string") for rows in (fixtures.GOLD, fixtures.PREDICTED))
    pairs = {(r.case_id, r.field_type, r.side, r.idx): r.other for r in matching.greedy_match(gold, pred).collect()}
    assert pairs[("c1", "people", "gold", 0)] == 0 and pairs[("c1", "people", "gold", 1)] is None and pairs[("c2", "amounts", "gold", 0)] == 0 and pairs[("c2", "amounts", "pred", 1)] is None
    best = H.resolved_category(spark.createDataFrame(fixtures.CATEGORIES, "wanted string, category string, category_id string, pos int"), F.col("wanted"), ("wanted",)).collect()
    assert {(r.wanted, r.category_id) for r in best} == set(fixtures.CATEGORY_ANSWERS)


def test_first_references_with_an_empty_name(spark):
    texts = spark.createDataFrame([(1, "Smith. Mayor Smith.", [("", "mayor"), ("A Smith", "mayor")])], "text_id long, text string, people array<struct<raw_name:string,role:string>>")
    assert [r.excerpt for r in style.first_references(texts).collect()] == ["A Smith"]
