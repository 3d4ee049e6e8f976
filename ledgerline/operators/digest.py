"""Digest text: published facts by section, and a template digest made of them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import constants as C
from ledgerline.functions.text import not_empty


def section_of(item_type: Column) -> Column:
    out = F.lit(C.OTHER_SECTION)
    for name, section in C.SECTION_OF_TYPE.items():
        out = F.when(item_type == name, F.lit(section)).otherwise(out)
    return out


def _listed(field: str, line) -> Column:
    return F.transform(F.coalesce(F.col(f"item.{field}"), F.expr("NULL")), lambda x: line(x["value"]))


def rendered_item(number: Column) -> Column:
    """The lines of one item's facts."""
    part = lambda prefix, value: F.concat(F.lit(prefix), not_empty(value))
    motion = lambda v: F.concat(F.lit("  - Motion: "), F.concat_ws(", ", F.concat_ws(" -- ", v["text"], F.concat(F.lit("outcome: "), v["outcome"])), part("moved by ", v["moved_by"]["raw_name"]), part("seconded by ", v["seconded_by"]["raw_name"]), part("tally ", v["tally"])))
    person = lambda v: F.concat(F.lit("  - Person: "), v["raw_name"], F.lit(" ("), v["role"], F.lit(")"))
    location = lambda v: F.concat(F.lit("  - Location: "), v["raw_text"])
    amount = lambda v: F.concat(F.lit("  - Amount: "), v["raw_text"], F.lit(" ("), v["kind"], F.lit(")"), F.coalesce(F.concat(F.lit(" = $"), v["amount_usd"]), F.lit("")))
    head = F.concat(F.lit("Item "), F.coalesce(number, F.lit("?")), F.lit(": "), F.col("item.title"))
    lists = [_listed("motions", motion), _listed("people", person), _listed("locations", location), _listed("amounts", amount)]
    return F.concat_ws("\n", head, *lists)


def rendered_facts(items: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Per meeting the fact block: sections in their order, items in source order; closed sessions are left out."""
    order = F.array_position(F.array(*map(F.lit, C.SECTION_ORDER)), F.col("section"))
    shown = F.col(key).isNotNull() & (F.col("item.item_type") != "closed_session")
    # rows of items that are not shown keep their meeting in the grouping; one shuffle by the key serves both groupings
    rows = items.select(key, "pos", F.when(shown, section_of(F.col("item.item_type"))).alias("section"), F.when(shown, rendered_item(F.col("item.item_number"))).alias("block")).repartition(F.col(key))
    per_section = rows.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("pos", "block")))).alias("l")).withColumn("body", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["block"]), "\n\n")))
    blocks = per_section.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct(order.alias("o"), "body")))).alias("l"))
    return blocks.select(key, F.coalesce(not_empty(F.array_join(F.transform("l", lambda x: x["body"]), "\n\n")), F.lit(C.EMPTY_FACTS)).alias("facts"))


def template_digest(facts: DataFrame, meetings: DataFrame, key: str = "meeting_id") -> DataFrame:
    """A digest from facts alone, without a model: a title, an overview line, the fact block.

    Neither side is small: Spark's estimates of texts and compressed files would send one of them through the driver.
    """
    df = facts.join(meetings.hint("merge"), key)
    title = F.concat(F.lit("# "), F.coalesce("jurisdiction", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")), F.lit(", "), F.coalesce("date", F.lit("")))
    return df.select(key, F.concat(title, F.lit("\n\n## Overview\n\nFacts of one meeting, by section.\n\n"), F.col("facts")).alias("digest_markdown"))
