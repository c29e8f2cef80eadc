"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all others as named
users. The result is the rendering in segments, one a turn: its text, where it starts, and which of its characters are trained
on. Segments in order, put together, are the rendered dialogue. A dialogue is never gathered into one row or task: starts are
sums over blocks of turns, and then sums within a block. Only numbers are summed; a turn's text moves once, to its block, and
is rendered there for each perspective.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one dialogue that are ordered together.
BLOCK = 256

#: Characters of a segment besides its head and its text, and those before the text besides the head.
MARKS, OPENING = len("<|im_start|>\n<|im_end|>\n"), len("<|im_start|>\n")

#: The block of turns without a number, before all others.
FIRST = -(2**63)


def rotate_perspectives(conversations: DataFrame, instructions: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per dialogue, participant and turn: conv_id, perspective, turn, segment, start, length, mask_start, mask_end.

    Speakers are the distinct values of role; those named in `instructions` give orders and are no participants: their turns
    keep their role from every perspective. A segment is `<|im_start|>`, role (with ` name=` and the speaker for users), a line
    break, the text, `<|im_end|>` and a line break. start, length and the mask count code points; of the speaker's own turns
    the text and the end mark are trained on ([mask_start, mask_end) from the start of the rendering), of others' nothing
    (both null). Turns are ordered by turn, then role, then text, nulls first. A null role is the speaker `unknown`, a null text
    is empty; null conv_ids are one dialogue. Repeated rows are repeated turns. A dialogue without participants, and an empty
    table, gives no rows. Columns but conv_id, turn, role and text are not read.
    """
    conv = conversations.schema["conv_id"].dataType
    gives_orders = F.col("role").isin(*instructions)
    said = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("conv_id", F.lit("0").cast(conv)).alias("c"), F.col("conv_id").isNull().alias("n"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(FIRST)).alias("block"),
    )
    name = F.when(gives_orders, F.col("role")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    said = said.withColumn("size", (F.length(name) + F.length("text") + MARKS).cast("long"))
    frames = _frames(said.groupBy("c", "n", "block", "role").agg(F.sum("size").alias("size"), F.count("*").alias("many")), gives_orders)

    own = F.col("role") == F.col("perspective")
    seen = said.join(frames.hint("merge"), ["c", "n", "block"]).withColumn("length", F.when(own, F.length("text") + len("assistant") + MARKS).otherwise(F.col("size")).cast("long"))
    within = Window.partitionBy("c", "n", "block", "perspective").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("start", F.col("base") + F.coalesce(F.sum("length").over(within), F.lit(0)))
    head = F.when(own, F.lit("assistant")).otherwise(name)
    return placed.select(
        "conv_id", "perspective", "turn", F.concat(F.lit("<|im_start|>"), head, F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n")).alias("segment"), "start", "length",
        F.when(own, F.col("start") + len("assistant") + OPENING).alias("mask_start"), F.when(own, F.col("start") + F.col("length") - 1).alias("mask_end"),
    )


def _frames(parts: DataFrame, gives_orders) -> DataFrame:
    """c, n, block, perspective and base: where a block begins in the rendering of each participant. parts: sizes by block and speaker, as others see them."""
    people = parts.filter(~gives_orders).select("c", "n", F.col("role").alias("perspective")).distinct()
    totals = parts.groupBy("c", "n", "block").agg(F.sum("size").alias("size"))
    shorter = F.col("many") * (len("assistant") - F.length(F.concat(F.lit("user name="), F.col("role"))))
    own = parts.select("c", "n", "block", F.col("role").alias("perspective"), shorter.alias("own"))
    sized = totals.join(people, ["c", "n"]).join(own, ["c", "n", "block", "perspective"], "left")
    before = Window.partitionBy("c", "n", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("size") + F.coalesce("own", F.lit(0))).over(before), F.lit(0))
    return sized.select("c", "n", "block", "perspective", base.alias("base"))
