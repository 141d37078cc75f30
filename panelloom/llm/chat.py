"""Perspective rotation of dialogues with several speakers, with DataFrame operations only.

For every speaker of a dialogue the whole dialogue is rendered once with that speaker as the assistant: the speaker's messages
become assistant messages and are to be learned, all others become messages of users named after their role, and system
messages stay what they are.  Messages are numbered without gathering a dialogue: they are sorted by range over all tasks and
numbered from each range's offset, so a dialogue that holds a third of all rows is spread.  A rendering is cut into parts of at
most ``part_messages`` messages; the parts in order are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def numbered(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``messages`` with ``place``, 0, 1, 2, ... inside each key in the given order (nulls first; equal rows in any order)."""
    tie = messages.withColumn("_tie", F.monotonically_increasing_id())
    sort = [F.col(c).asc_nulls_first() for c in (*order, "_tie")]
    ranges = cut_lineage(tie.repartitionByRange(F.col(key), *sort).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(key), "_range", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range", key).orderBy(*sort)) - 1
    own = ranges.withColumn("_inside", inside)
    return own.join(offsets, [key, "_range"]).select(*messages.columns, (F.col("_before") + F.col("_inside")).cast("long").alias("place"))


def segment(role: Column, text: Column, speaker: Column) -> Column:
    """One rendered message and the span in it that is to be learned: (text, begin, end), null ends if it is not."""
    own = role == speaker
    head = F.when(own, F.lit(f"{BEGIN}assistant\n")).when(role == SYSTEM, F.lit(f"{BEGIN}system\n")) \
        .otherwise(F.concat(F.lit(f"{BEGIN}user name="), F.coalesce(role, F.lit("unknown")), F.lit("\n")))
    body = F.concat(F.coalesce(text, F.lit("")), F.lit(END))
    return F.struct(F.concat(head, body, F.lit("\n")).alias("text"), F.when(own, F.length(head)).alias("begin"),
                    F.when(own, F.length(head) + F.length(body)).alias("end"))


def rotate(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           part_messages: int = 512) -> DataFrame:
    """conv_id, speaker, part, n_messages, rendered, mask (begin-end of every learned span of ``rendered`` in code points, joined
    by commas) and n_learned (code points in them).

    Speakers are the roles of a dialogue but system.  Messages are ordered by turn, then role and text, nulls first.  A message
    without a role is said by the user ``unknown``, who is no speaker; a null text is empty; repeated rows are messages of their
    own; rows without a conv_id belong to no dialogue and give no rows, as do dialogues without a speaker.  A learned span is the
    content and the end mark.  Other columns are not read.
    """
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")) \
        .where("conv_id is not null")
    placed = numbered(rows, "conv_id", ["turn", "role", "text"])
    speakers = rows.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("speaker")).distinct()
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / part_messages).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("messages"))  # at most part_messages
    # the parts of one dialogue may be many and so may its speakers; the join's skew is split at run time
    turned = parts.join(speakers, "conv_id").select("conv_id", "speaker", "part", F.transform(
        "messages", lambda m: segment(m["role"], m["text"], F.col("speaker"))).alias("segments"))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("learned"))
    spans = F.aggregate("segments", start, lambda acc, s: F.struct(
        (acc["at"] + F.length(s["text"])).alias("at"),
        F.when(s["begin"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.concat_ws(
            "-", (acc["at"] + s["begin"]).cast("string"), (acc["at"] + s["end"]).cast("string"))))).alias("spans"),
        (acc["learned"] + F.coalesce(s["end"] - s["begin"], F.lit(0))).alias("learned")))
    done = turned.select("conv_id", "speaker", "part", "segments", spans.alias("mask"))
    return done.select("conv_id", "speaker", F.col("part").cast("long").alias("part"), F.size("segments").cast("long").alias("n_messages"),
                       F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("rendered"),
                       F.array_join("mask.spans", ",").alias("mask"), F.col("mask.learned").alias("n_learned"))
