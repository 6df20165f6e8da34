"""Sources mixed to target weights: temperature, then budgeted block permutations.

The weight of a source is its share of tokens raised to an exponent, normalised.  The exponent is
bisected to meet a target entropy or a limit on repetition; both change monotonically with it.
A source's weight times the budget is its quota of tokens: whole passes over the source, each in an
own permutation of blocks, and one part pass.  The part pass takes the permutation as far as the
quota reaches; what the first document that is too long leaves over is filled by the shortest
documents left, so a source stays below its quota by less than its shortest unused document.

Defined results: a null source is a source of its own; texts without words cost nothing and are
part of every whole pass; repeated rows are rows of their own; without tokens every row is used
once.  Sources, not documents, are held on the driver: mixtures name few of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from auditmill.llm.common import dense_rank_in

BLOCK_ROWS = 10_000


def tokens(text: Column) -> Column:
    """Words between white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Normalised powers of positive shares."""
    logs = [exponent * math.log(s) for s in shares]
    top = max(logs)
    powers = [math.exp(x - top) for x in logs]
    return [p / math.fsum(powers) for p in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: list[float], weights: list[float]) -> float:
    """Passes over the most repeated source when the least repeated one is passed once."""
    passes = [w / s for w, s in zip(weights, shares, strict=True)]
    return max(passes) / min(passes)


def exponent_for(shares: list[float], target_entropy: float | None = None, max_repetition: float | None = None, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that keeps the repetition limit, or the one that gives the entropy."""
    if target_entropy is not None:
        def too_flat(x):
            return entropy(tempered(shares, x)) > target_entropy
    else:
        limit = math.inf if max_repetition is None else max_repetition

        def too_flat(x):
            return repetition(shares, tempered(shares, x)) > limit
    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    if too_flat(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of ``docs(doc_id, text, source, ...)``, once per pass that uses them.

    Added: ``n_tokens``, ``weight`` of the source, ``epoch`` (pass, from 0) and ``position`` in the
    pass.  ``budget`` in tokens; without one it is the smallest that passes every source once.
    """
    rows = docs.drop("n_tokens", "weight", "epoch", "position").withColumn("n_tokens", tokens(F.col("text")))
    held = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    held = sorted(held, key=lambda r: (r["source"] is not None, r["source"] or ""))
    with_text = [r for r in held if r["n"]]
    total = sum(r["n"] for r in with_text)
    shares = [r["n"] / total for r in with_text]
    weights = tempered(shares, exponent_for(shares, target_entropy, max_repetition)) if shares else []
    if budget is None:
        budget = max((math.ceil(r["n"] / w) for r, w in zip(with_text, weights, strict=True)), default=0)
    plan = []
    weight_of = {r["source"]: w for r, w in zip(with_text, weights, strict=True)}
    for r in held:
        w = weight_of.get(r["source"], 0.0)
        # rounding must not turn a whole pass into one that misses a token
        full, rest = divmod(int(w * budget + 1e-6 * r["n"]), r["n"]) if r["n"] else (1, 0)
        plan.append((r["source"], w, int(full), int(rest), 1 + r["rows"] // BLOCK_ROWS))
    spark, kind = docs.sparkSession, docs.schema["source"].dataType
    fields = [T.StructField("_source", kind), T.StructField("weight", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("_full", "_rest", "_blocks"))]
    quotas = F.broadcast(spark.createDataFrame(plan, T.StructType(fields)))
    # ids may be missing or repeated: the text takes part in the place of a row
    passes = rows.withColumn("_place", F.xxhash64("doc_id", "text", F.lit(seed))).join(quotas, F.col("source").eqNullSafe(F.col("_source")))
    passes = passes.withColumn("_block", F.pmod("_place", "_blocks")).withColumn(
        "epoch", F.explode(F.when(F.col("_full") + (F.col("_rest") > 0).cast("int") > 0, F.sequence(F.lit(0).cast("long"), F.col("_full") - (F.col("_rest") == 0).cast("int")))))
    order = [F.xxhash64("_place", "epoch"), F.col("doc_id"), F.col("n_tokens")]
    # blocks in an order of their own in every pass
    ranked = dense_rank_in(passes, ["_source", "epoch"], order, F.xxhash64("_block", "epoch", "_source", F.lit(seed)), "position", {"_used": F.col("n_tokens")})
    whole = F.col("epoch") < F.col("_full")
    part = ~whole & (F.col("_used") + F.col("n_tokens") <= F.col("_rest")) & (F.col("n_tokens") > 0)
    taken = ranked.filter(whole | part)
    helpers = ["_source", "_full", "_rest", "_blocks", "_block", "_used", "_place"]
    filled = ranked.filter(part).groupBy("_source").agg(F.sum("n_tokens").alias("n")).collect() if any(p[3] for p in plan) else []
    filled = {r["_source"]: r["n"] for r in filled}
    gaps = [(p[0], p[3] - filled.get(p[0], 0)) for p in plan]
    gaps = [g for g in gaps if g[1] > 0]
    if not gaps:
        return taken.drop(*helpers)
    gap = F.broadcast(spark.createDataFrame(gaps, T.StructType([T.StructField("_gap_source", kind), T.StructField("_gap", T.LongType())])))
    left = ranked.filter(~whole & ~part & (F.col("n_tokens") > 0)).join(gap, F.col("_source").eqNullSafe(F.col("_gap_source")))
    left = left.filter(F.col("n_tokens") <= F.col("_gap")).drop("_used")
    left = dense_rank_in(left, ["_source", "epoch"], order, F.col("n_tokens") * F.col("_blocks") + F.col("_block"), "_turn", {"_used": F.col("n_tokens")})
    more = left.filter(F.col("_used") + F.col("n_tokens") <= F.col("_gap"))
    return taken.drop(*helpers).unionByName(more.drop(*helpers, "_gap_source", "_gap", "_turn"))
