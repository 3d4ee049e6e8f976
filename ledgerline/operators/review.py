"""The review queue: rows for queued facts, decisions, summary, export of reviewed facts as labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.operators.facts import VALUES


def queue_items(routed: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Queued facts as pending review items. context: case_id and the meeting's columns and document_text; none where facts carry these."""
    queued = routed.where("route = 'queued'")
    queued = queued if context is None else queued.join(context, "case_id")
    return queued.withColumns({"status": F.lit("pending"), "resolved_value": F.lit(None).cast("string"), "reviewer_notes": F.lit(None).cast("string")})


def upserted(stored: DataFrame, changed: DataFrame, key: str = "queue_id") -> DataFrame:
    """The stored rows with changed ones in place of those with their key; of several changes of a key, the last by `version`."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(changed.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_late"), F.desc("version"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_late")


def with_status(queue: DataFrame, status: str | None = None) -> DataFrame:
    return queue if status is None else queue.where(F.col("status") == status)


def summary(queue: DataFrame) -> DataFrame:
    """Counts per status, zeros too, and the total: one row."""
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in C.REVIEW_STATUSES], F.count("*").alias("total"))


def edited_value(field: Column, value: Column, text: Column) -> Column:
    """The value (JSON) with its primary member replaced."""
    out = value
    for name, member in C.PRIMARY_FIELD.items():
        out = F.when(field == name, F.to_json(F.from_json(value, VALUES[name]).withField(member, text))).otherwise(out)
    return out


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending items with their decisions applied; only rows that change.

    decisions: queue_id, decision (accept, edit, reject, skip), text (of edits), note. Skipped items stay as they are.
    """
    rows = queue.where("status = 'pending'").join(decisions.where("decision IN ('accept', 'edit', 'reject')"), "queue_id")
    status = F.when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "edit", "edited").otherwise("rejected")
    resolved = F.when(F.col("decision") == "edit", edited_value(F.col("field_type"), F.col("value"), F.col("text"))).otherwise(F.col("resolved_value"))
    return rows.withColumns({"status": status, "resolved_value": resolved, "reviewer_notes": F.coalesce("note", "reviewer_notes")}).drop("decision", "text", "note")


def session_tally(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    pending = queue.where("status = 'pending'").select("queue_id").join(decisions, "queue_id")
    return pending.agg(*[F.count_if(F.col("decision") == d).alias(n) for d, n in (("accept", "accepted"), ("edit", "edited"), ("reject", "rejected"), ("skip", "skipped"))])


def gold_cases(queue: DataFrame, strict: bool = True) -> DataFrame:
    """Reviewed items as labelled cases of one field. strict: others raise an error, else they are left out."""
    done = F.col("status").isin("accepted", "edited")
    rows = queue.withColumn("_ok", F.when(done, True).otherwise(F.raise_error(F.concat(F.lit("not accepted or edited: "), F.col("queue_id"))).cast("boolean"))).where("_ok").drop("_ok") if strict else queue.where(done)
    singular = F.lit("fact")
    for name, one in C.SINGULAR.items():
        singular = F.when(F.col("field_type") == name, F.lit(one)).otherwise(singular)
    value = F.when(F.col("status") == "edited", F.coalesce("resolved_value", "value")).otherwise(F.col("value"))
    return rows.select(
        F.concat(F.lit("review-"), F.col("queue_id")).alias("case_id"), "field_type", F.lit(0).alias("idx"), value.alias("value"), "source_text", "source_document", "document_text",
        F.array("field_type").alias("annotated_fields"), F.concat(F.lit("One reviewed "), singular, F.lit(".")).alias("notes"),
    )
