"""Document fingerprints of closed syncmers, with DataFrame functions only.

A text is a sequence of units: runs of non-blank characters. Runs of more than `UNIT_BYTES` bytes are cut after certain
bytes (about one in eight), so unspaced texts have units too, and an edit in one changes only the units it touches.
Before the first unit and after the last stand `K` - 1 ends. A k-mer of `K` units or ends is kept where the least hash of
its inner substrings (single units; an end is above all) lies at its first or last place: a third of them, and in any text
that has a unit at least its first and its last. Whether a k-mer is kept depends on itself alone, so an edit elsewhere in
the text leaves it in place: kept k-mers are anchors that two texts share wherever they share the words. The definition is
the same for texts of all lengths. A fingerprint lists each anchor's place and 32 bits of its hash.

Two fingerprints are matched by hash, wherever the anchors stand, so text put in or taken out shifts nothing away;
`matched` gives the places on both sides. Likeness is shared over all distinct anchors of the two fingerprints. One word
changed in every `K` leaves no anchor.

Cases: null and empty texts have the empty fingerprint, and two empty ones are alike (1.0); an empty and another are not
(0.0); a null doc_id counts as the least id, ties go by text, repeated rows are all kept; an only document is its own
next; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import id_and_text, read_table, shuffle_width, with_range_bucket

UNIT_BYTES = 24
K = 6


_CUTS = "".join(rf"\x{b:02X}" for b in range(0x21, 0xC0) if b % 8 == 5)
_PIECES = rf"[^{_CUTS}]*+[{_CUTS}]|[^{_CUTS}]++"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, where `use` reads it within lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def unit_hashes(text: Column) -> Column:
    """The units' hashes: of whole runs, and of the pieces of runs of more than `UNIT_BYTES` bytes."""
    as_bytes = lambda run: F.decode(F.encode(run, "UTF-8"), "ISO-8859-1")  # one character for each byte
    pieces = lambda run: F.transform(F.regexp_extract_all(as_bytes(run), F.lit(_PIECES), F.lit(0)), lambda u: F.xxhash64(F.encode(u, "ISO-8859-1")))
    hashes = lambda run: F.when(F.octet_length(run) > UNIT_BYTES, pieces(run)).when(run == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.xxhash64(run)))
    for blank in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.flatten(F.transform(F.split(text, " "), hashes))  # a split at one character needs no regular expression


def anchors_of(text: Column) -> Column:
    """array<struct<p, v>>: the anchors' places (of their first unit, from 1; below 1 in the ends before the text) and hashes."""
    ends = F.array_repeat(F.lit(2**63 - 1), K - 1)
    return bound(F.concat(ends, unit_hashes(text), ends), _anchors)


def _anchors(padded: Column) -> Column:
    units = F.size(padded) - 2 * (K - 1)
    kmer = lambda i: [F.get(padded, i + j) for j in range(K)]  # element by element: a slice of the array costs ten times as much
    closed = lambda u: F.least(u[0], u[-1]) <= F.least(*u[1:-1])
    kept = F.filter(F.sequence(F.lit(0), units + (K - 2)), lambda i: closed(kmer(i)))
    anchors = F.transform(kept, lambda i: F.struct((i - (K - 2)).alias("p"), F.xxhash64(*kmer(i)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")))
    return F.when(units > 0, anchors).otherwise(F.expr("cast(array() as array<struct<p:int,v:bigint>>)"))


def fingerprint_text(anchors: Column) -> Column:
    """place.hash of every anchor: the place in decimal, the hash in hex."""
    return F.array_join(F.transform(anchors, lambda a: F.concat(a["p"].cast("string"), F.lit("."), F.hex(a["v"]))), " ")


def hashes_of(anchors: Column) -> Column:
    return F.transform(anchors, lambda w: w["v"])


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes (`hashes_of`) of two fingerprints, from 0 to 1."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def matched(a: Column, b: Column) -> Column:
    """array<struct<v, a, b>>: the anchors of a that b has, with their places in a and their first place in b."""
    there = hashes_of(b)
    return F.filter(F.transform(a, lambda x: F.struct(x["v"].alias("v"), x["p"].alias("a"), F.get(b, F.array_position(there, x["v"]).cast("int") - 1)["p"].alias("b"))), lambda m: m["b"].isNotNull())


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, anchors_of(F.col(text)))


def with_next(docs: DataFrame, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """Each row beside `columns` (as next_...) of the row after it in descending doc_id, after the last the first.

    Rows go to ranges of ids; the first row of a range also goes, as an extra, to the range that precedes it in this
    order. So all ranges are sorted side by side, each row is sent once or twice, and no task sees all rows.
    """
    width = shuffle_width(docs.sparkSession)
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    keyed, ends = with_range_bucket(keyed, "_key", 3 * width, "_bucket")
    top = keyed.agg(F.max("_key")).first()[0]
    last = len(ends)
    at_end = F.element_at(F.array(*[F.lit(int(x)) for x in ends], F.lit(int(top if top is not None else 0))), F.col("_bucket") + 1) == F.col("_key")
    # ends[i] is the first of range i; range i + 1 needs it. The first of all rows goes to range 0.
    goes_to = F.when(F.col("_key") == F.lit(top), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x")), F.struct(F.lit(0).alias("b"), F.lit(True).alias("x"))))
    if last:
        goes_to = goes_to.when(at_end, F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x")), F.struct((F.col("_bucket") + 1).alias("b"), F.lit(True).alias("x"))))
    goes_to = goes_to.otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("x"))))
    dealt = keyed.select("doc_id", "text", "_key", F.explode(goes_to).alias("_to")).select("doc_id", "text", "_key", F.col("_to.b").alias("_b"), F.col("_to.x").alias("_extra")).repartition(width, "_b")
    order = Window.partitionBy("_b").orderBy("_extra", F.col("_key").desc(), "text")
    led = prepare(dealt).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.where(~F.col("_extra")).drop("_key", "_b", "_extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""
    return with_anchors(id_and_text(docs), "text", "anchors").select("doc_id", fingerprint_text(F.col("anchors")).alias("fingerprint"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike they and the next document's are."""
    docs = id_and_text(read_table(spark, sf_dir, "documents"))
    rows = with_next(docs, ["text", "hashes"], lambda df: with_anchors(df, "text", "anchors").withColumn("hashes", hashes_of(F.col("anchors"))))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "anchors", "hashes", "next_hashes", edited.alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors").withColumn("edited_hashes", hashes_of(F.col("edited_anchors")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("anchors")).alias("fingerprint"), fingerprint_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
