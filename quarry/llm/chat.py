"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and every other speaker as a named ``user``; system
turns stay system turns for everybody.  Only the assistant's words (and the
end mark after them) are trained on: ``mask`` holds their character spans.

A rendered dialogue is cut every ``CHUNK`` turns (one row each, numbered), so
no row or group grows with a conversation; an ordinary conversation is one
row.  Positions of turns come from counts per block of turn numbers plus a
rank within the block, so a very long conversation is not ordered in one
task.

Edge cases: turns are ordered by turn number, then role, then text (null
first); exact repeats of a turn count once, different turns under one number
are all kept; a null role is the speaker ``unknown``; a null or empty text
is an empty turn; a null conv_id is a conversation of its own; control marks
inside a text are defused; a conversation with only system turns has no
perspective and no row; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 64
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def defuse(text: Column) -> Column:
    """Control marks in a text become ordinary characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def placed_turns(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, speaker, body, chunk, at): every distinct turn with the
    chunk it falls in and its place there."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    t = t.withColumn("block", F.floor(F.col("turn") / chunk))
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("block").eqNullSafe(F.col("__b")))
    rank = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")) + F.col("before") - 1
    return t.withColumn("rank", rank).select(
        "conv_id", "speaker", defuse(F.col("text")).alias("body"),
        F.floor(F.col("rank") / chunk).alias("chunk"), (F.col("rank") % chunk).alias("at"))


def render_perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, perspective, chunk, n_turns, text, mask`` where ``mask``
    is an array of [start, end) character spans in ``text``."""
    placed = placed_turns(turns, chunk)
    speakers = (turns.select("conv_id", F.coalesce("role", F.lit(UNKNOWN)).alias("perspective")).where(F.col("perspective") != SYSTEM)
                .distinct().withColumnRenamed("conv_id", "__c"))
    seen = placed.join(speakers, F.col("conv_id").eqNullSafe(F.col("__c")))
    mine = F.col("speaker") == F.col("perspective")
    label = (F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(mine, F.lit("assistant"))
             .otherwise(F.concat(F.lit("user name="), defuse(F.col("speaker")))))
    head = F.concat(F.lit(START), label, F.lit("\n"))
    part = F.struct("at", head.alias("head"), F.concat("body", F.lit(END)).alias("body"), (mine & (F.col("speaker") != SYSTEM)).alias("mine"))
    grouped = seen.groupBy("conv_id", "perspective", "chunk").agg(F.sort_array(F.collect_list(part)).alias("p"))   # at most `chunk` turns
    # Spans: lengths accumulated turn by turn.
    spans = F.expr("""aggregate(p, struct(0 as upto, cast(array() as array<array<int>>) as mask),
        (s, x) -> struct(s.upto + length(x.head) + length(x.body) + 1 as upto,
            if(x.mine, concat(s.mask, array(array(s.upto + length(x.head), s.upto + length(x.head) + length(x.body)))), s.mask) as mask),
        s -> s.mask)""")
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return grouped.select("conv_id", "perspective", "chunk", F.size("p").alias("n_turns"), text.alias("text"), spans.alias("mask"))
