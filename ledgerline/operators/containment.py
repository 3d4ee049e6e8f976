"""Which spans stand verbatim in which documents, by an index of rare word runs instead of a test of all pairs.

A span's inner words (those with a border on both sides inside it) are whole words of every document that holds it, in a
row. So a run of `RUN` of them, or one where there are fewer, must stand in the document. Runs that some span has are
counted over all documents, every span is looked up by its rarest one, and only ids meet until then; texts are fetched
once for the candidates of a document, some at a time.

A span without an inner word (a part of a word, or of two) is looked up among the distinct words of all documents, by
pieces of `PIECE` characters; one of blanks only among the distinct runs of blanks. An empty span stands in every
document. All joins have keys, and no span and no document is tested against all of the other side.

Null texts hold nothing, null spans stand nowhere; rows that repeat an id count once for each text; further columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run, characters of a piece, spans that are tested on a text at a time, salts of empty spans.
RUN, PIECE, TESTED_AT_ONCE, SALTS = 3, 3, 500, 16


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _runs(df: DataFrame, words: str, size: int, *keep: str) -> DataFrame:
    """A row for each run of so many words, as a hash; zipped slices stay outside of lambdas, so the words are split once."""
    if size == 1:
        rows = df.select(*keep, F.explode(words).alias("w0"))
    else:
        zipped = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(size)])
        rows = df.select(*keep, F.explode(zipped).alias("z")).select(*keep, "z.*").where(f"w{size - 1} IS NOT NULL")
    return rows.select(*keep, F.xxhash64(F.lit(size), *[f"w{i}" for i in range(size)]).alias("run"))


def _prepared(spans: DataFrame) -> DataFrame:
    """item_id, source_text, words, inner words, and the size of the runs that it is looked up by (0: it has no inner word)."""
    words = _words(F.col("source_text"))
    df = spans.where("source_text IS NOT NULL").select("item_id", "source_text", words.alias("words"))
    first = F.when(F.col("source_text").rlike(r"^\s"), 1).otherwise(2)
    last = F.size("words") - F.when(F.col("source_text").rlike(r"\s\z"), 0).otherwise(1)
    df = df.withColumn("inner", F.slice("words", first, F.greatest(last - first + 1, F.lit(0))))
    return df.withColumn("size", F.when(F.size("inner") >= RUN, RUN).when(F.size("inner") > 0, 1).otherwise(0))


def _by_runs(words: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Candidates (doc_id, item_id) of the spans of this size. words: doc_id, words."""
    wanted = _runs(spans.where(F.col("size") == size), "inner", size, "item_id").distinct()
    hits = _runs(words, "words", size, "doc_id").join(wanted.select("run").distinct(), "run", "left_semi").distinct()
    counts = hits.groupBy("run").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "run", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
    return hits.join(rarest.where("best.n > 0").select("item_id", F.col("best.run").alias("run")), "run").select("doc_id", "item_id")


def _pieces(text: Column) -> Column:
    """The pieces of a text of PIECE characters or more, or all its shorter ones."""
    chars = F.char_length(text)

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(chars - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(of, range(1, PIECE + 1)))))


def _by_parts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates of spans without an inner word: the longest of their words stands inside a word of the document."""
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    short = spans.where("size = 0 AND source_text != ''").select("item_id", F.coalesce(longest, F.col("source_text")).alias("part"))
    short = short.withColumn("piece", F.substr("part", F.lit(1), F.least(F.char_length("part"), F.lit(PIECE))))
    blank = F.array_distinct(F.filter(F.split("text", r"\S+"), lambda w: w != ""))
    tokens = docs.select("doc_id", F.explode(F.concat(F.array_distinct(_words(F.col("text"))), blank)).alias("token"))
    known = tokens.select("token").distinct().select("token", F.explode(_pieces(F.col("token"))).alias("piece"))
    fits = known.join(short, "piece").where(F.contains("token", "part")).select("token", "item_id").distinct()
    return tokens.join(fits, "token").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, item_id) of spans (item_id, source_text) that stand in documents (doc_id, text)."""
    docs, known = docs.select("doc_id", "text").where("text IS NOT NULL"), _prepared(spans)
    sizes = {r["size"] for r in known.select("size").distinct().collect()}  # at most three
    words = docs.select("doc_id", _words(F.col("text")).alias("words"))
    found = [_by_runs(words, known, size) for size in sorted(sizes - {0})]
    if 0 in sizes:
        found.append(_by_parts(docs, known))
    if not found:
        return docs.select("doc_id").join(spans.select("item_id"), F.lit(False)).limit(0)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    held = candidates.join(known.select("item_id", "source_text"), "item_id")
    per_doc = candidates.groupBy("doc_id").agg(F.ceil(F.count("*") / TESTED_AT_ONCE).alias("parts"))
    held = held.join(per_doc, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("item_id", "source_text")).alias("spans"))
    tested = held.join(docs, "doc_id").select("doc_id", F.explode(F.filter("spans", lambda s: F.contains(F.col("text"), s["source_text"]))["item_id"]).alias("item_id"))
    if 0 not in sizes:
        return tested.distinct()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    empty = known.where("source_text = ''").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return tested.unionByName(docs.select("doc_id", salt.alias("salt")).join(empty, "salt").select("doc_id", "item_id")).distinct()
