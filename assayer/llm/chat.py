"""Chat logs: conversations that are the beginning of a longer one collapse into it, the rest is rendered.

A log that stores a snapshot after every turn holds each conversation many
times. Every turn has a 128-bit hash of its place, role and text; the xor over
the first k turns names that beginning. A conversation goes if its whole name is
the name of a proper beginning of another one (an anti join); of equal
conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import pinned

OPENING, CLOSING = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts as empty, rows that repeat a turn completely only once."""
    plain = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return plain.withColumn("h1", F.xxhash64(F.lit(1), "role", "text")).withColumn("h2", F.xxhash64(F.lit(2), "text", "role"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn, then hash), p1 and p2 (names of the beginning that ends here).

    Turns are range-partitioned on (conv_id, turn), so that a conversation of any
    length is cut into slices; windows hold a slice, or one row for each slice.
    """
    narrow = turns.select("conv_id", "turn", "h1", "h2").distinct()
    # A fixed slice number for each row: the stored table is what all later steps read.
    sliced = pinned(
        narrow.repartitionByRange("conv_id", "turn", "h1").withColumn("slice", F.spark_partition_id()), "chat-slices"
    )
    order = [F.col("turn").asc_nulls_first(), "h1", "h2"]
    at = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    sizes = sliced.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("s_id"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = F.col("conv_id").eqNullSafe(F.col("s_id")) & (F.col("slice") == F.col("s_slice"))
    placed = sliced.withColumn("at", at).join(starts, same).withColumn("place", F.col("start") + F.col("at"))
    named = pinned(
        placed.select("conv_id", "turn", "slice", "place", "h1", "h2", F.xxhash64("place", "h1").alias("x1"), F.xxhash64("h2", "place").alias("x2")),
        "chat-places",
    )
    running = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    folded = named.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    offsets = folded.select(
        F.col("conv_id").alias("s_id"),
        F.col("slice").alias("s_slice"),
        F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("o1"),
        F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("o2"),
    )
    inside = named.withColumns({"r1": F.bit_xor("x1").over(running), "r2": F.bit_xor("x2").over(running)})
    return inside.join(offsets, same).select(
        "conv_id",
        "turn",
        "h1",
        "h2",
        "place",
        F.col("r1").bitwiseXOR(F.col("o1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("o2")).alias("p2"),
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations to keep."""
    lengths = placed.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumnRenamed("conv_id", "l_id")
    rows = placed.join(lengths, F.col("conv_id").eqNullSafe(F.col("l_id")))
    whole = (
        rows.where("place = n_turns")
        .groupBy("n_turns", "p1", "p2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    )
    beginnings = rows.where("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(beginnings, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPENING), role, F.lit("\n"), text, F.lit(CLOSING + "\n"))


def chat_texts(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, copies, rendered.

    Turns are ordered by ``turn`` (nulls first; equal numbers by a hash of role
    and text). Null roles and texts count as empty, a row that repeats a turn
    completely counts once, rows without conv_id are one conversation. ``copies``
    counts the equal conversations, of which the smallest id stays. A rendered
    conversation is one text and so one cell. An empty table gives no rows;
    other columns are not looked at.
    """
    turns = turns_of(conversations)
    placed = pinned(placed_turns(turns), "chat-placed")
    kept = pinned(maximal(placed), "chat-kept").withColumnRenamed("conv_id", "k_id")
    wanted = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("k_id"))).select(
        "k_id", "n_turns", "copies", "place", F.col("turn").alias("k_turn"), F.col("h1").alias("k1"), F.col("h2").alias("k2")
    )
    same = F.col("conv_id").eqNullSafe(F.col("k_id")) & F.col("turn").eqNullSafe(F.col("k_turn")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    pieces = turns.join(wanted, same).select("k_id", "n_turns", "copies", F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("piece")).alias("p"))
    gathered = pieces.groupBy("k_id", "n_turns", "copies").agg(F.sort_array(F.collect_set("p")).alias("pieces"))
    return gathered.select(F.col("k_id").alias("conv_id"), "n_turns", "copies", F.array_join("pieces.piece", "").alias("rendered"))
