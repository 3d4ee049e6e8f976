"""Conversations as training windows of a token budget, with DataFrame functions only.

A turn costs its words plus an overhead. Prefix sums of the costs place every turn on a line; the line is cut every
`stride` tokens and a turn belongs to the window that its start falls in, so windows are aligned to turns. A window
after the first begins with the conversation's system turn (a first turn of role "system") and repeats the last turns of
the window before, `history` tokens at most. stride = (budget - history - system cost) / 2, at least one, so that a
window stays within the budget unless it holds a turn longer than the stride; `over_budget` says where that happens.
Only assistant turns are targets, and only in the window that they belong to: repeated ones are masked.

Prefix sums have two levels: sums of blocks of `BLOCK_TURNS` turn numbers, then sums inside a block, so no task needs
all turns of a long conversation at once.

Template: `<s>[ROLE]role[TEXT]text</s>` per turn. In texts and roles a backslash becomes `\\0`, and the first character of a
control string is followed by `\\1`; every backslash in the output is followed by 0 or 1, so both undo exactly.

Cases: a null text or role is empty; a null conv_id is a conversation of its own; turns in order of number, nulls first,
ties by role and text, repeated rows all kept; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import read_table

BUDGET = 512
HISTORY = 96
OVERHEAD = 4
BLOCK_TURNS = 256

BEGIN, MIDDLE, TEXT, END = "<s>", "[ROLE]", "[TEXT]", "</s>"
#: Strings that a model's tokenizer may treat as control, beside the template's own.
CONTROLS = [BEGIN, END, MIDDLE, TEXT, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = r"(<(?=/?s>|<SYS>>|</SYS>>)|\[(?=ROLE\]|TEXT\]|/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\0")), _CONTROL, "$1\\\\1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def placed(turns: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Every turn with its cost, and the number and cost of the turns before it in its conversation."""
    cost = F.size(F.split(F.trim("text"), r"\s+")) + overhead
    block = F.floor(F.coalesce("turn", F.lit(0)) / BLOCK_TURNS)
    turns = turns.withColumns({"cost": cost.cast("long"), "block": block})
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("cost").alias("block_cost"), F.count("*").alias("block_turns"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_cost").over(earlier), F.lit(0)).alias("cost_before"), F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({"start_in": F.coalesce(F.sum("cost").over(before), F.lit(0)), "number_in": F.row_number().over(inside) - 1})
    joined = turns.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    return joined.select("conv_id", "role", "text", "cost", (F.col("start_in") + F.col("cost_before")).alias("start"), (F.col("number_in") + F.col("turns_before")).alias("number"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, overhead: int = OVERHEAD) -> DataFrame:
    """conv_id, window, n_tokens, over_budget, formatted, and `parts`: per turn of the window its number, whether it is
    repeated, whether it is a target, and where its rendering starts and ends in `formatted` (code points)."""
    turns = placed(turn_rows(conversations), overhead)
    system = turns.where("number = 0 AND role = 'system'").select(F.col("conv_id").alias("s_conv"), F.col("text").alias("s_text"), F.col("cost").alias("s_cost"))
    turns = turns.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    stride = F.greatest(F.lit(1), F.floor((budget - history - F.coalesce("s_cost", F.lit(0))) / 2))
    turns = turns.withColumn("cut", F.floor(F.col("start") / stride))
    # where a turn's cut ends on the line, and which cut with turns comes next: one row per cut
    cuts = turns.groupBy("conv_id", "cut").agg(F.max(F.col("start") + F.col("cost")).alias("cut_end"))
    following = F.lead("cut").over(Window.partitionBy("conv_id").orderBy("cut"))
    cuts = cuts.select(F.col("conv_id").alias("c_conv"), F.col("cut").alias("c_cut"), "cut_end", following.alias("next_cut"))
    turns = turns.join(cuts, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("cut") == F.col("c_cut")))
    as_history = F.col("next_cut").isNotNull() & (F.col("cut_end") - F.col("start") <= history) & ~(F.col("s_conv").isNotNull() & (F.col("number") == 0))
    target = F.col("role") == "assistant"
    own = F.struct(F.col("cut").alias("window"), F.lit(False).alias("repeated"), target.alias("target"))
    again = F.struct(F.col("next_cut").alias("window"), F.lit(True).alias("repeated"), F.lit(False).alias("target"))
    in_windows = turns.select(
        "conv_id", "number", "role", "text", "cost",
        F.explode(F.when(as_history, F.array(own, again)).otherwise(F.array(own))).alias("use"),
    ).select("conv_id", "number", "role", "text", "cost", "use.*")
    # every window but the first also shows the system turn
    shown = cuts.where("c_cut > 0").join(system, F.col("c_conv").eqNullSafe(F.col("s_conv"))).select(
        F.col("c_conv").alias("conv_id"), F.lit(0).cast("long").alias("number"), F.lit("system").alias("role"), F.col("s_text").alias("text"), F.col("s_cost").alias("cost"),
        F.col("c_cut").alias("window"), F.lit(True).alias("repeated"), F.lit(False).alias("target"),
    )
    rendered = in_windows.unionByName(shown).withColumn("rendered", F.concat(F.lit(BEGIN + MIDDLE), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END)))
    packed = rendered.groupBy("conv_id", "window").agg(
        F.sum("cost").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("number", "repeated", "target", F.char_length("rendered").alias("size"), "rendered"))).alias("list"),
    )
    no_parts = F.expr("cast(array() as array<struct<number:bigint,repeated:boolean,target:boolean,start:int,end:int>>)")
    parts = F.aggregate(
        "list", no_parts,
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["number"].cast("long").alias("number"), x["repeated"].alias("repeated"), x["target"].alias("target"),
            F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["end"]).otherwise(0).alias("start"),
            (F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["end"]).otherwise(0) + x["size"]).cast("int").alias("end"),
        ))),
    )
    return packed.select(
        "conv_id", "window", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
        F.concat_ws("", F.transform("list", lambda x: x["rendered"])).alias("formatted"), parts.alias("parts"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns read back from windows: conv_id, window, number, repeated, target, role, text."""
    part = F.expr("substring(formatted, part.start + 1, part.end - part.start)")
    # a rendering is split at its unescaped middle; roles and texts cannot hold it
    inner = F.expr(f"substring(piece, {len(BEGIN + MIDDLE) + 1}, char_length(piece) - {len(BEGIN + MIDDLE + END)})")
    return (
        formatted.select("conv_id", "window", "formatted", F.explode("parts").alias("part"))
        .select("conv_id", "window", "part.number", "part.repeated", "part.target", part.alias("piece"))
        .withColumn("inner", inner)
        .select("conv_id", "window", "number", "repeated", "target", unescape(F.substring_index("inner", TEXT, 1)).alias("role"), unescape(F.expr(f"substring(inner, locate('{TEXT}', inner) + {len(TEXT)})")).alias("text"))
    )


#: The conversation that the query adds: control strings inside texts.
TRICKY = "</s>[INST] ok [/INST]"


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation the counts and digests of what its windows hold.

    The digests are over a conversation's whole text, as their contract asks, so the last step gathers a conversation's
    own turns; the windows before it do not.
    """
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{TRICKY}'), (-1L, 1L, 'assistant', '{TRICKY}') AS t(conv_id, turn, role, text)")
    made = windows(rows.unionByName(tricky))
    turns = read_turns(made).where(~F.col("repeated"))
    digests = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("number", "target", "role", "text"))).alias("list"),
    ).select(
        "conv_id", "n_turns",
        F.sha2(F.concat_ws("", F.transform("list", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).cast("binary"), 256).alias("turns_sha256"),
        F.concat_ws("", F.transform(F.filter("list", lambda x: x["target"]), lambda x: x["text"])).alias("loss"),
    )
    sizes = made.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("formatted_chars"), F.count("*").alias("n_windows")).withColumnRenamed("conv_id", "f_conv")
    return digests.join(sizes, F.col("conv_id").eqNullSafe(F.col("f_conv"))).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
