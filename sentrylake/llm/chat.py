"""Chat formatting by rotation of perspective.

For every participant of a conversation the whole dialogue is rendered with that participant as the
assistant and all others as named users; system turns stay system turns. Only the text and end mark of the
assistant's turns are trained on. The result has one row per participant and turn: the rendered segment,
where it lies in the dialogue (the segments in order, code points, end exclusive) and the part of it that is
trained on (empty where none). Rows instead of whole dialogues, because a conversation has no bound: its turns are ranked by
ranges and their lengths summed in chunks, so that a conversation of a third of all rows is spread. ``dialogues``
puts the segments together as text, in parts of bounded length.

Defined cases: a null text is empty; a null speaker is a user named ``unknown`` and no participant; a null
conv_id is a conversation of its own; null turns come last, equal ones by speaker and text; repeated rows
are turns of their own; a conversation of system turns alone has no rows; marks of the format inside a
text lose their bars, and control characters, blanks and marks in names become ``_``; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import position_in_group

CHUNK = 4096  # turns whose lengths one window sums
PART = 1 << 20  # code points at which a rendered dialogue goes on in another row
START, END = "<|im_start|>", "<|im_end|>\n"


def _body(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_(start|end)\|>", "<im_$1>")


def _name(speaker: Column) -> Column:
    return F.regexp_replace(F.coalesce(speaker, F.lit("unknown")), r"[\x00-\x20<>|]", "_")


def _header(perspective: Column, speaker: Column, system: Sequence[str]) -> Column:
    role = (
        F.when(speaker.isin(*system), F.lit("system"))
        .when(speaker == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), _name(speaker)))
    )
    return F.concat(F.lit(START), role, F.lit("\n"))


def rotate(conversations: DataFrame, system: Sequence[str] = ("system",)) -> DataFrame:
    """conv_id, turn, speaker, text -> one row per participant and turn."""
    turns = stage(
        conversations.select(
            "conv_id", "turn", F.col("role").alias("speaker"), _body(F.col("text")).alias("body"),
            F.monotonically_increasing_id().alias("_n"),
        ),
        "turns",
    )
    slim = turns.select("_n", "conv_id", "turn", "speaker", F.length("body").alias("size"), F.xxhash64("body").alias("_tie"))
    order = [F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.col("_tie"), F.col("_n")]
    placed = position_in_group(slim, ["conv_id"], order, "turn-places")
    people = placed.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system))
    people = people.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = placed.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "_n", "conv_id", "perspective", "place", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"),
        (F.length(_header(F.col("perspective"), F.col("speaker"), system)) + F.col("size") + len(END)).alias("length"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("place")
    seen = stage(seen.withColumn("_to", F.sum("length").over(inside)), "turn-lengths")
    chunks = seen.groupBy(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("chunk").alias("_chunk"))
    earlier = Window.partitionBy("_conv", "_who").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.agg(F.sum("length").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("chunk") == F.col("_chunk"))
    )
    offsets = seen.join(before, same).select(
        "_n", "perspective", (F.col("_before") + F.col("_to") - F.col("length")).alias("start"),
        (F.col("_before") + F.col("_to")).alias("stop"),
    )
    header = _header(F.col("perspective"), F.col("speaker"), system)
    trained = F.col("speaker").eqNullSafe(F.col("perspective"))
    return turns.join(offsets, "_n").select(
        "conv_id", "perspective", "turn", "speaker", F.concat(header, F.col("body"), F.lit(END)).alias("segment"),
        "start", "stop", trained.alias("trained"),
        F.when(trained, F.col("start") + F.length(header)).otherwise(F.col("stop")).alias("mask_start"),
        F.when(trained, F.col("stop") - 1).otherwise(F.col("stop")).alias("mask_stop"),
    )


def dialogues(rotated: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, start, text, masks: the rendered dialogue of every participant with its masks.

    A dialogue is one row, or if it is longer several that follow each other: a segment is in the part in which it
    begins. ``masks`` are the spans to train on, in code points of the whole dialogue, end exclusive.
    """
    rows = rotated.select("conv_id", "perspective", F.floor(F.col("start") / part).alias("part"), "start", "segment", "trained", "mask_start", "mask_stop")
    ordered = F.sort_array(F.collect_list(F.struct("start", "segment", "trained", "mask_start", "mask_stop")))
    held = rows.groupBy("conv_id", "perspective", "part").agg(ordered.alias("_s"))
    spans = F.transform(F.filter("_s", lambda x: x["trained"]), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_stop"].alias("stop")))
    return held.select(
        "conv_id", "perspective", "part", F.col("_s")[0]["start"].alias("start"),
        F.array_join(F.transform("_s", lambda x: x["segment"]), "").alias("text"), spans.alias("masks"),
    )
