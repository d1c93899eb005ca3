"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

A logged conversation is often a snapshot: the same turns as an earlier log, and some more. Each turn carries a rolling hash
of the conversation up to it (two 64-bit hashes of position, role and text, XORed over a running window). A conversation
whose last hash is an inner hash of another one is a prefix of it; among equal conversations the smallest id stays. Both
are anti-joins on hashes with distinct right sides, pre-aggregated, so a first turn or a conversation that a third of all
rows share costs a row a task. What stays is maximal and is rendered.

Defined cases: turns are in order of turn (null first), then role, then text; null roles and texts render as empty and
differ from empty ones in the hash; repeated rows of one turn are one turn; rows without a conv_id are left out; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# The markers of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), h1, h2 (rolling hashes), role, text: a row a turn."""
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.distinct().withColumn("n", F.row_number().over(inside))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda seed: F.xxhash64(F.lit(seed), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return placed.withColumn("h1", F.bit_xor(one(1)).over(upto)).withColumn("h2", F.bit_xor(one(2)).over(upto))


def maximal(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns with their hashes, and (conv_id, n_turns, n_logged) of the conversations that stay."""
    turns = scratch.table(turn_hashes(conversations), "turns")
    prefixes = turns.select("conv_id", "n", "h1", "h2")
    ends = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("n", "h1", "h2"), "n").alias("e")).select("conv_id", "e.*")
    whole = ends.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = prefixes.join(ends.select("conv_id", F.col("n").alias("turns")), "conv_id").filter("n < turns").select("n", "h1", "h2").distinct()
    return turns, whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_logged")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (equal conversations), text of the maximal conversations."""
    turns, kept = maximal(conversations, Scratch(conversations.sparkSession, "chat_format"))
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{END}\n"))
    lines = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    return kept.join(lines, "conv_id").select("conv_id", "n_turns", "n_logged", F.array_join(F.col("lines.line"), "").alias("text"))
