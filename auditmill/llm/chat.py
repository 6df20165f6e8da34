"""Logged conversations: cumulative snapshots collapsed, then rendered.  DataFrame functions only.

A chat service that logs the whole conversation at every request leaves snapshots that are prefixes
of longer ones.  Every turn gets a rolling hash of all turns up to it; a conversation whose last
hash occurs at the same place of a longer conversation is a prefix of it and is removed by an
anti-join.  Of equal conversations the one with the smallest id stays.

Hashes are sums of per-turn hashes that contain the turn's place, so prefixes are running sums;
they are formed in blocks of turns and shifted by what the blocks before hold, and the text of a long
conversation is rendered in as many parts.  So no conversation has to fit one task.

Defined results: exact repeats of a turn count once; turns are ordered by number (null first), then
role and text, and compared by place; a null role is rendered as ``unknown``, a null text as empty;
turns with a null conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditmill.llm.common import dense_rank_in

TURNS_TOGETHER = 1024
#: Two sums of this many bits each: numbers of turns up to 2 ** 22 cannot overflow them.
BITS = 40


def place_hash(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("place"), F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))), F.lit(1 << BITS))


def placed(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``place`` (from 0) and the sums ``h1``, ``h2`` of the hashes up to and with the turn."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    block = F.coalesce(F.floor(F.col("turn") / TURNS_TOGETHER), F.lit(-(1 << 60)))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    ranked = dense_rank_in(turns, ["conv_id"], order, block, "place")
    rolled = dense_rank_in(ranked, ["conv_id"], [F.col("place")], F.floor(F.col("place") / TURNS_TOGETHER), "_same",
                           {"s1": place_hash(1), "s2": place_hash(2)})
    return rolled.withColumns({"h1": F.col("s1") + place_hash(1), "h2": F.col("s2") + place_hash(2)}).drop("_same", "s1", "s2")


def covered(turns: DataFrame) -> DataFrame:
    """Ids of the conversations that are prefixes of longer ones, or repeat one with a smaller id."""
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("w")).select(F.col("conv_id").alias("_conv"), F.col("w.place").alias("last"), "w.h1", "w.h2")
    ends = turns.join(whole.select("_conv", "last"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    # one row per different prefix, however many conversations begin with it
    prefixes = ends.groupBy("place", F.col("h1").alias("p1"), F.col("h2").alias("p2")).agg(
        F.max("last").alias("longest"), F.min(F.when(F.col("last") == F.col("place"), F.col("conv_id"))).alias("first"))
    same = (F.col("last") == F.col("place")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2"))
    return whole.join(prefixes, same).filter((F.col("longest") > F.col("last")) | ~F.col("_conv").eqNullSafe(F.col("first"))).select(F.col("_conv").alias("gone"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): the parts of a conversation in order give its text."""
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    parts = turns.select("conv_id", F.floor(F.col("place") / TURNS_TOGETHER).alias("part"), F.struct("place", piece.alias("piece")).alias("t"))
    return parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", "part", "n_turns", F.array_join(F.col("t.piece"), "").alias("rendered"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """Collapse ``conversations(conv_id, turn, role, text)`` and render what stays."""
    turns = placed(conversations)
    return render(turns.join(covered(turns), F.col("conv_id").eqNullSafe(F.col("gone")), "left_anti"))
