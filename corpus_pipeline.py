"""A corpus pipeline: STAGES in order, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.

1. quality: documents that the positive-unlabelled classifier scores below its threshold go.
2. near_duplicates: of each class of the n-gram Jaccard join, the document with the least id stays.
3. decontamination: documents that hold a copy of a benchmark item go.
4. secrets: secrets in texts are masked and n_chars is counted anew; no row goes.
5. tokens: the ids of every text, checked by decoding them.

Cases, for every stage: an empty table gives an empty one with the same columns (quality without a trusted positive scores
all alike, 0.5, and keeps all); columns beside doc_id, text and n_chars, whatever their names, are passed on as they are up to the last stage.
Nulls and repeated rows:
1. a null text is scored as an empty one; null ids are never learned from; repeated rows are decided each, alike.
2. null and empty texts are in no class and stay; rows with a null id stay; of rows with one id all stay or none.
3. null texts hold no copy and stay; null ids and repeated rows are decided each.
4. null texts stay null, with the n_chars they had; null ids and repeated rows are masked each.
5. a null text has no ids and decodes to the empty string; null ids and repeated rows are encoded each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe_codec, decontaminate, jaccard_trees, quality_pu, secrets_crf
from ledgerline.llm.common import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, prior = quality_pu.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_pu.keep_good(docs, model, prior)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_trees.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_crf.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe_codec.round_trip(docs, path, pattern)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: A learned classifier and a conditional random field have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
