"""Deterministic text rules: one row of findings for each breach of a rule in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions import text as T
from ledgerline.operators.scoring import with_prf
from ledgerline.sources.snapshots import answered

FINDINGS = ["text_id", "rule", "severity", "message", "excerpt"]
DETERMINISTIC_RULES = [
    "missing_header", "missing_overview", "section_order", "unexpected_section", "unknown_citation", "missing_citation",
    "banned_construction", "paragraph_too_long", "sentence_too_long", "reading_level", "missing_first_reference_title",
]


_FOUND = "array<struct<rule:string,severity:string,message:string,excerpt:string>>"


def _finding(rule: str, severity: str, message: Column | str, excerpt: Column | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), (F.lit(None).cast("string") if excerpt is None else excerpt).alias("excerpt"))


def _when(breach: Column, *finding) -> Column:
    return F.when(breach, F.array(_finding(*finding)).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _with_parts(texts: DataFrame) -> DataFrame:
    """texts with what several rules look at, made once a text; parts that no rule asks for are pruned."""
    df = texts.withColumns({"low": F.lower(T.or_empty(F.col("text"))), "found": T.headings(F.col("text")), "body": T.without_overview(F.col("text")), "sentences": T.sentences(F.col("text")), "paragraphs": T.paragraphs(F.col("text"))})
    return df.withColumns({"said": F.when(F.col("body") == F.col("text"), F.col("sentences")).otherwise(T.sentences(F.col("body"))), "grade": T.reading_grade(F.col("text"), F.col("sentences"))})


def _findings(texts: DataFrame, *rules) -> DataFrame:
    """One row for each finding of the rules; each text is read once for all of them."""
    return _with_parts(texts).select("text_id", F.inline(F.concat(*[found for rule in rules for found in rule()]))).select(*FINDINGS)


def _structure() -> list[Column]:
    order = F.array(*map(F.lit, C.SECTION_ORDER))
    known = F.filter("found", lambda h: F.array_contains(order, h))
    wanted = F.filter(order, lambda h: F.array_contains(F.col("found"), h))
    return [
        _when(~T.or_empty(F.col("text")).rlike(r"(?U)\A\s*+# \s*+\S"), "missing_header", "high", "The text does not begin with a title line."),
        _when(~F.array_contains("found", "Overview"), "missing_overview", "high", "There is no Overview section."),
        _when(known != wanted, "section_order", "medium", "Sections are not in the required order.", F.array_join(known, ", ")),
        F.transform(F.filter("found", lambda h: ~F.array_contains(order, h)), lambda h: _finding("unexpected_section", "low", F.concat(F.lit("Unexpected section: "), h), h)),
    ]


def structure(texts: DataFrame) -> DataFrame:
    return _findings(texts, _structure)


def _citation_rules() -> list[Column]:
    known = F.coalesce("known_item_numbers", F.array())
    unknown = F.filter(F.when(F.size(known) > 0, T.citations(F.col("body"))).otherwise(F.array().cast("array<string>")), lambda item: ~F.array_contains(known, item))
    bare = F.filter("said", lambda s: (T.has_amount(s) | T.has_outcome_verb(s)) & (F.size(T.citations(s)) == 0))
    return [
        F.transform(unknown, lambda item: _finding("unknown_citation", "high", F.concat(F.lit("Cites an item that is not known: "), item), item)),
        F.transform(bare, lambda s: _finding("missing_citation", "high", "States an amount or an outcome without citing an item.", T.snippet(s))),
    ]


def citation_rules(texts: DataFrame) -> DataFrame:
    """Every cited number is known (where any is), and sentences with an amount or an outcome cite an item; not in Overview."""
    return _findings(texts, _citation_rules)


def _banned() -> list[Column]:
    phrases = F.filter(F.array(*map(F.lit, C.BANNED_PHRASES)), lambda p: F.contains(F.col("low"), p))
    return [
        F.transform(phrases, lambda p: _finding("banned_construction", "medium", F.concat(F.lit("Banned phrase: "), p), p)),
        _when(F.contains("text", F.lit("!")), "banned_construction", "low", "Exclamation mark."),
        _when(F.contains("low", F.lit("you")) & F.col("text").rlike(r"(?iU)(?=y)\byour?\b"), "banned_construction", "medium", "Addresses the reader."),
    ]


def banned(texts: DataFrame) -> DataFrame:
    return _findings(texts, _banned)


def _too_long(pieces: str, words: int, rule: str, kind: str) -> Column:
    long = F.filter(pieces, lambda b: (F.char_length(b) > 2 * words) & T.more_words_than(b, words))  # so many words and the blanks between them
    return F.transform(long, lambda b: _finding(rule, "low", F.concat(T.word_count(b).cast("string"), F.lit(f" words in a {kind}.")), T.snippet(b)))


def _lengths() -> list[Column]:
    return [_too_long("paragraphs", C.PARAGRAPH_WORDS, "paragraph_too_long", "paragraph"), _too_long("sentences", C.SENTENCE_WORDS, "sentence_too_long", "sentence")]


def lengths(texts: DataFrame) -> DataFrame:
    return _findings(texts, _lengths)


def _reading_level() -> list[Column]:
    return [_when(F.col("grade") > C.READING_GRADE, "reading_level", "low", F.concat(F.lit("Reading grade "), F.format_number("grade", 1)))]


def reading_level(texts: DataFrame) -> DataFrame:
    return _findings(texts, _reading_level)


def _first_references() -> list[Column]:
    def titled(p: Column) -> Column:
        title = F.lit(None).cast("string")
        for role, name in C.FIRST_REFERENCE_TITLES.items():
            title = F.when(p["role"] == role, F.lit(name)).otherwise(title)
        return F.struct(p["raw_name"].alias("name"), title.alias("title"), F.try_element_at(F.array_append(T.words(p["raw_name"]), F.lit(None)), F.lit(-2)).alias("surname"))

    def placed(x: Column) -> Column:
        plain = F.regexp_instr("text", F.concat(F.lit(r"(?U)\b\Q"), x["surname"], F.lit(r"\E\b")))
        return F.struct(x["name"].alias("name"), plain.alias("plain"), F.instr(F.col("text"), F.concat(x["title"], F.lit(" "), x["surname"])).alias("titled"))

    people = F.coalesce("people", F.expr("cast(array() as array<struct<raw_name:string,role:string>>)"))
    named = F.filter(F.transform(people, titled), lambda x: x["title"].isNotNull() & x["surname"].isNotNull())
    wrong = F.filter(F.transform(named, placed), lambda x: (x["plain"] > 0) & ((x["titled"] == 0) | (x["plain"] < x["titled"])))
    return [F.transform(wrong, lambda x: _finding("missing_first_reference_title", "medium", F.concat(F.lit("First mention lacks a title: "), x["name"]), x["name"]))]


def first_references(texts: DataFrame) -> DataFrame:
    """Mayors and councilmembers whose surname stands before the first titled mention, or has none."""
    return _findings(texts, _first_references)


def check_deterministic(texts: DataFrame) -> DataFrame:
    """All findings. texts: text_id, text, known_item_numbers array<string>, people array<struct<raw_name, role>>."""
    return _findings(texts, _structure, _citation_rules, _banned, _lengths, _reading_level, _first_references)


def judged(texts: DataFrame, provider) -> DataFrame:
    """Findings of a model tier. provider(text, facts) gives (rule, severity, message, excerpt) tuples; it runs by partition."""
    schema = "text_id string, rule string, severity string, message string, excerpt string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, *f) for i, t, facts in zip(pdf["text_id"], pdf["text"], pdf["facts_block"]) for f in provider(t, facts) if f[0] in C.JUDGE_RULES]
            yield pd.DataFrame(rows, columns=FINDINGS)

    return texts.select(F.col("text_id").cast("string").alias("text_id"), "text", "facts_block").mapInPandas(run, schema)


def judged_by_store(texts: DataFrame, kept, provider, version: str, model: str) -> DataFrame:
    """Findings of the model tier, each text asked for once: answers come from, and go to, a keyed store.

    texts: text_id, text, facts_block. provider(request JSON) gives a JSON list of findings (rule, severity, message,
    excerpt); findings of other rules than the judge's are left out, a text that the provider refuses has none.
    """
    asked = texts.select(F.col("text_id").cast("string").alias("text_id"), F.lit(version).alias("prompt_version"), F.lit(model).alias("model"), F.to_json(F.struct(F.col("text"), F.coalesce("facts_block", F.lit("")).alias("facts"))).alias("request"))
    answers = answered(asked, kept, provider).select("text_id", F.from_json("response", "array<struct<rule:string,severity:string,message:string,excerpt:string>>").alias("found"))
    return answers.select("text_id", F.explode("found").alias("f")).select("text_id", "f.*").where(F.col("rule").isin(C.JUDGE_RULES))


def both_tiers(texts: DataFrame, kept, provider, version: str = "v1", model: str = "rules") -> DataFrame:
    """Findings of both tiers with their `tier`. Only texts without a finding of high severity are put to the second."""
    first = check_deterministic(texts).withColumn("text_id", F.col("text_id").cast("string"))
    stopped = first.where("severity = 'high'").select("text_id").distinct()
    passed = texts.withColumn("text_id", F.col("text_id").cast("string")).join(stopped, "text_id", "left_anti")
    second = judged_by_store(passed, kept, provider, version, model)
    return first.withColumn("tier", F.lit("rules")).unionByName(second.withColumn("tier", F.lit("judge")))


def style_case_scores(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Pooled scores per tier and rule. cases: text_id, expected (rule names); findings as of `both_tiers`."""
    actual = findings.select("text_id", "rule").distinct()
    wanted = cases.select(F.col("text_id").cast("string").alias("text_id"), F.explode(F.array_distinct("expected")).alias("rule"))
    pairs = wanted.withColumn("wanted", F.lit(1)).join(actual.withColumn("found", F.lit(1)), ["text_id", "rule"], "full")
    tier = F.when(F.col("rule").isin(C.JUDGE_RULES), "judge").otherwise("rules")
    counts = [F.count_if(F.col("wanted").isNotNull() & F.col("found").isNotNull()).alias("tp"), F.count_if(F.col("wanted").isNull()).alias("fp"), F.count_if(F.col("found").isNull()).alias("fn")]
    return with_prf(pairs.groupBy(tier.alias("tier"), "rule").agg(*counts))


def passes(findings: DataFrame) -> bool:
    """Whether no finding is of high severity."""
    return findings.where("severity = 'high'").isEmpty()


def context_of(items: DataFrame) -> DataFrame:
    """Per text: distinct item numbers, and people with the role of their first mention. items: text_id, pos, item_number, people."""
    people = items.select("text_id", "pos", F.posexplode("people").alias("i", "p")).groupBy("text_id", "p.raw_name").agg(F.min_by("p.role", F.struct("pos", "i")).alias("role"), F.min(F.struct("pos", "i")).alias("at"))
    people = people.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("at", "raw_name", "role"))).alias("l")).select("text_id", F.transform("l", lambda x: F.struct(x["raw_name"].alias("raw_name"), x["role"].alias("role"))).alias("people"))
    numbers = items.groupBy("text_id").agg(F.array_sort(F.collect_set(T.not_empty(F.col("item_number")))).alias("known_item_numbers"))
    return numbers.join(people, "text_id", "left").withColumn("people", F.coalesce("people", F.expr("cast(array() as array<struct<raw_name:string,role:string>>)")))
