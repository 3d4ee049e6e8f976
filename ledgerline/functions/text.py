"""Text functions as Column expressions. All stay inside the JVM; patterns are Unicode-aware where Python's are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import constants as C


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def not_empty(text: Column) -> Column:
    """NULL where the text is empty, as truth values of strings need."""
    return F.nullif(text, F.lit(""))


#: What Python's str.strip takes away, beyond what a pattern's \\s has.
_BLANK = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """Without whitespace of any kind at either end; '' for NULL."""
    return F.regexp_extract(or_empty(text), rf"(?sU)\A{_BLANK}*+(.*[^\s\x1c-\x1f])", 1)  # back from the end, not at every blank


def lines(text: Column) -> Column:
    """The lines of a text, at every kind of line break."""
    return F.split(F.regexp_replace(or_empty(text), r"\R|[\x1c-\x1e]", "\n"), "\n")  # split would compile the pattern for every text


def normalize(text: Column) -> Column:
    """Lower case, one space for each run of whitespace, none at the ends; '' for NULL."""
    return F.trim(F.regexp_replace(F.lower(or_empty(text)), rf"(?U){_BLANK}+", " "))


def clean_cell(text: Column) -> Column:
    """No-break spaces as spaces, NULL where nothing is left."""
    return not_empty(F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" "))))


def slug(name: Column, trim: bool = False, slashes: bool = False) -> Column:
    out = F.replace(F.lower(F.trim(name) if trim else name), F.lit(" "), F.lit("-"))
    return F.replace(out, F.lit("/"), F.lit("-")) if slashes else out


def words(text: Column) -> Column:
    return F.filter(F.split(or_empty(text), rf"(?U){_BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def more_words_than(text: Column, n: int) -> Column:
    """Whether the text has more than n words; looks no further than the one after the nth."""
    return or_empty(text).rlike(rf"(?U)\A{_BLANK}*+(?:[^\s\x1c-\x1f]++{_BLANK}++){{{n}}}[^\s\x1c-\x1f]")


def sentences(text: Column) -> Column:
    """Sentences of the lines that are neither blank nor headings; a listed abbreviation ends none."""
    no_abbreviation = "".join(rf"(?<!\b{a}\.\s)" for a in C.ABBREVIATIONS)
    ends = rf"(?U)\s(?<=[.!?]\s){no_abbreviation}\s*"  # the blank first, as most places have none; a line has no \n of its own
    kept = F.filter(F.transform(lines(text), stripped), lambda x: (x != "") & ~x.startswith("#"))
    return F.filter(F.flatten(F.transform(kept, lambda x: F.split(F.regexp_replace(x, ends, "\n"), "\n"))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without those that begin as a heading."""
    return F.filter(F.transform(F.split(or_empty(text), "\n\n"), stripped), lambda p: (p != "") & ~p.startswith("#"))


def snippet(text: Column, limit: int = C.SNIPPET_CHARS) -> Column:
    clean = F.when(text.isNotNull(), stripped(text))
    cut = lambda c: F.when(F.char_length(c) > limit, F.concat(F.regexp_replace(F.left(c, F.lit(limit)), rf"(?U){_BLANK}+\z", ""), F.lit("..."))).otherwise(c)
    return F.get(F.transform(F.array(clean), cut), F.lit(0))  # so that it is stripped once


def context_snippet(document: Column, span: Column, radius: int = C.CONTEXT_RADIUS) -> Column:
    """The span with `radius` characters on either side, ellipses where text is cut; the span alone where it is absent."""
    at = F.instr(document, span)
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + F.char_length(span) - 1 + radius, F.char_length(document))
    piece = F.substring(document, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(""), piece, F.when(end < F.char_length(document), F.lit("...")).otherwise(""))).otherwise(span)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit("[A-Za-z']+"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel clusters, less a final silent e where there are others, one at least."""
    low = F.lower(word)
    n = F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0)))
    return F.greatest(F.lit(1), n - F.when(low.endswith("e") & (n > 1), 1).otherwise(0))


def reading_grade(text: Column, split: Column | None = None) -> Column:
    """Flesch-Kincaid grade; 0 without words or sentences. Words count in headings too, sentences do not.

    Syllables of all words at once: one for each word, and one for each further vowel cluster of it, less the silent e.
    split: the text's sentences, where they are at hand.
    """
    many = lambda pattern: F.regexp_count(or_empty(text), F.lit(pattern))
    vowel, no_vowel = "[aeiouyAEIOUY]", "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ']"
    more = many(rf"{vowel}{no_vowel}++(?={vowel})(?!{vowel}++(?<=[eE])(?![A-Za-z']))")
    counts = F.struct(many("[A-Za-z']+").alias("n"), more.alias("more"), F.size(sentences(text) if split is None else split).alias("s"))

    def grade(c: Column) -> Column:
        syl = c["n"] + c["more"]
        return F.when((c["n"] == 0) | (c["s"] == 0), F.lit(0.0)).otherwise(F.lit(0.39) * (c["n"] / c["s"]) + F.lit(11.8) * (syl / c["n"]) - F.lit(15.59))

    return F.get(F.transform(F.array(counts), grade), F.lit(0))  # so that each is counted once


def headings(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(r"(?U)\(Item\s+([\w.]+)\)"), F.lit(1))


def without_overview(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), r"(?ms)^##\s+Overview\s*$.*?(?=^##\s|\z)", "")


def has_amount(text: Column) -> Column:
    return text.rlike(r"\$[\d,]+")


def has_outcome_verb(text: Column) -> Column:
    return F.lower(text).rlike("|".join(C.OUTCOME_VERBS))


def verified(source_text: Column, document: Column) -> Column:
    """Whether the span stands verbatim in the document; false where either is NULL."""
    return F.coalesce(F.contains(document, source_text), F.lit(False))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacement of {name}; braces inside values stay as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), or_empty(value))
    return template
