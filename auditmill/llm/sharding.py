"""Balanced shards that keep linked documents together, by label propagation under quotas.

Documents with equal texts are linked.  They start in random shards; in every round they move
towards the shard that holds most of their neighbours, as far as quotas allow: into a shard with
room, or in exchange for as many that want to go the other way.  Members of a group in one shard
are alike, so the state is a table (group, shard, members), never a list of members or of links.
Unlinked documents fill the shards up at the end, to counts that differ by one at most.

Law: ``rows``.  Defined results: null texts are linked with nothing and have no bytes; empty texts
are equal texts; repeated rows are rows of their own; with fewer rows than shards some stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from auditmill.llm.common import dense_rank_in, utf8_bytes
from auditmill.session import materialize

CELL = 50_000  # rows that are numbered together
SETTLED = 0.002  # the share of linked documents that two rounds must move to go on


def _uniform(*columns):
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def propagate(state: DataFrame, target: list[int], rounds: int) -> DataFrame:
    """Move members of ``state(grp, shard, n)`` towards their groups' fullest shards.

    Rounds take turns: moves into shards with room, then exchanges between pairs of shards.  It ends
    when a round of either kind moves next to nothing.  The quotas come from sums per pair of
    shards (at most shards x shards rows on the driver).
    """
    idle = 0
    for i in range(rounds):
        load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, t - load.get(s, 0)) for s, t in enumerate(target)]
        exchange = i % 2 == 1
        open_to = [s for s in range(len(target)) if exchange or room[s] > 0]
        best = state.filter(F.col("shard").isin(open_to)).groupBy(F.col("grp").alias("g")).agg(
            F.max(F.struct("n", F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("to"))).alias("best"))
        own = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        wish = state.join(best, F.col("grp") == F.col("g"), "left").select(
            "grp", "shard", "n", F.when((own < F.col("best")) & (F.col("best.to") != F.col("shard")), F.col("best.to")).alias("to"))
        wish = materialize(wish, "wishes")
        asked = {(r.shard, r.to): r.n for r in wish.filter("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        into: dict[int, int] = {}
        for (_, t), n in asked.items():
            into[t] = into.get(t, 0) + n
        share = {k: min(1.0, (asked.get(k[::-1], 0) / n) if exchange else room[k[1]] / into[k[1]]) for k, n in asked.items()}
        pairs = [F.lit(x) for k, v in share.items() for x in (f"{k[0]} {k[1]}", v)]
        moves = sum(n * share[k] for k, n in asked.items())
        idle = idle + 1 if moves <= SETTLED * sum(load.values()) else 0
        if idle == 2:
            break
        if not moves:
            continue
        quota = F.coalesce(F.create_map(*pairs)[F.concat_ws(" ", "shard", "to")], F.lit(0.0))
        moved = wish.withColumn("m", F.when(F.col("to").isNull(), 0).otherwise(
            F.least("n", F.floor(F.col("n") * quota + _uniform("grp", "shard", F.lit(i)) * (quota < 1).cast("int")))))
        stay = moved.select("grp", "shard", (F.col("n") - F.col("m")).alias("n"))
        gone = moved.filter("m > 0").select("grp", F.col("to").alias("shard"), F.col("m").alias("n"))
        state = materialize(stay.unionByName(gone).groupBy("grp", "shard").agg(F.sum("n").cast("long").alias("n")).filter("n > 0"), "labels")
    return state


def shard(docs: DataFrame, shards: int = 24, rounds: int = 16) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = materialize(docs.select(
        "doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.unhex(F.md5("text")).alias("grp")), "rows")
    total = rows.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialize(rows.filter("grp is not null").groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "groups")
    split = materialize(rows.join(groups, F.col("grp") == F.col("g"), "left").drop("g"), "split")
    linked, single = split.filter("members is not null"), split.filter("members is null")

    start = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int").alias("shard")
    state = propagate(materialize(linked.groupBy("grp", start).agg(F.count(F.lit(1)).alias("n")), "labels"), target, rounds)

    # what a shard holds too much of, by rounding of quotas, goes to the unlinked
    cell = F.pmod(F.xxhash64("grp"), F.lit(1 + total // CELL))
    placed = dense_rank_in(state, ["shard"], [F.col("grp")], cell, "_r", {"first": F.col("n")})
    limit = F.array(*map(F.lit, target))[F.col("shard")]
    placed = placed.withColumn("n", F.least("n", F.greatest(limit - F.col("first"), F.lit(0)))).filter("n > 0").select("grp", "shard", "n", "first")
    upto = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per shard
    placed = materialize(placed.withColumn("lo", F.coalesce(F.sum("n").over(upto), F.lit(0))), "placed")
    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}

    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    at = dense_rank_in(linked, ["grp"], order, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / CELL)), "p")
    where = placed.groupBy(F.col("grp").alias("g")).agg(F.collect_list(F.struct("lo", "n", "shard", "first")).alias("at"))
    held = at.join(where, F.col("grp") == F.col("g"), "left").withColumn(
        "at", F.get(F.filter("at", lambda x: (x.lo <= F.col("p")) & (F.col("p") < x.lo + x.n)), F.lit(0)))
    held = materialize(held.select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), (F.col("at.first") + F.col("p") - F.col("at.lo")).alias("slot")), "held")

    rest = single.select("doc_id", "size", "text_crc32").unionByName(held.filter("shard is null").select("doc_id", "size", "text_crc32"))
    ranked = dense_rank_in(rest, [], order, F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 + total // CELL)), "r")
    gaps, lo = [], 0
    for s, t in enumerate(target):
        n = load.get(s, 0)
        gaps.append(F.struct(F.lit(s).alias("shard"), F.lit(lo).cast("long").alias("lo"), F.lit(t - n).cast("long").alias("n"), F.lit(n).cast("long").alias("first")))
        lo += t - n
    gap = F.get(F.filter(F.array(*gaps), lambda x: (x.lo <= F.col("r")) & (F.col("r") < x.lo + x.n)), F.lit(0))
    filled = ranked.withColumn("at", gap).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), (F.col("at.first") + F.col("r") - F.col("at.lo")).alias("slot"))
    return held.filter("shard is not null").unionByName(filled).select(
        "doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
