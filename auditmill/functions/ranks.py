"""Ranks, percentiles and running totals over a whole table, without a single-task sort.

A global ``percentile`` aggregate or an unpartitioned window puts every distinct value
in one task.  Here values are first reduced to (value, weight), cut into ranges by
approximate quantiles, and running totals are formed inside each range plus the total
of the ranges before it.  The result is exact; only the cut points are approximate.

The (value, weight) table is read several times, so it is written once to the shared
folder first; it has one row per distinct value, however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill.session import materialize

RANGES = 256


def cuts_below(cuts: Column, value: Column, ranges: int) -> Column:
    """How many of the fewer than ``ranges`` ascending ``cuts`` are below ``value``, by halving."""
    steps = [1 << i for i in reversed(range((ranges - 1).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        F.get(cuts, at + step - F.lit(1)) < value, at + step).otherwise(at))


def running_totals(values: DataFrame, value: str, sums: list[str], by: str | None = None,
                   ranges: int = RANGES) -> DataFrame:
    """Add ``<c>_upto`` (sum of ``c`` over values <= this one) and ``<c>_total``.

    ``values`` has one row per (``by``, ``value``).  ``by`` names a column with few values,
    such as a model or a grid candidate: its cut points are held in a map.
    """
    cuts = [i / ranges for i in range(1, ranges)]
    approx = F.percentile_approx(value, cuts, 10_000)
    total = [F.sum(c).alias(c) for c in sums]
    if by:
        per_key = values.groupBy(by).agg(approx.alias("cuts"), F.struct(*total).alias("t"))
        lookup = per_key.agg(F.map_from_entries(
            F.collect_list(F.struct(by, F.struct("cuts", "t").alias("v")))).alias("m")).scalar()
        info: Column = lookup[F.col(by)]
    else:
        info = values.agg(F.struct(approx.alias("cuts"), F.struct(*total).alias("t")).alias("v")).scalar()
    keys = ([by] if by else []) + ["_range"]
    ranged = values.withColumn("_info", info).withColumns({
        "_range": cuts_below(F.col("_info.cuts"), F.col(value), ranges),
        **{f"{c}_total": F.col(f"_info.t.{c}") for c in sums},
    }).drop("_info")
    # at most ``ranges`` rows per key
    before = Window.partitionBy(*([by] if by else [])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys).agg(*total).select(
        *keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy(*keys).orderBy(value)
    return (
        ranged.join(offsets, keys)
        .withColumns({f"{c}_upto": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums})
        .drop("_range", *[f"_before_{c}" for c in sums])
    )


def exact_percentiles(df: DataFrame, value: str, shares, by: str | None = None) -> DataFrame:
    """Linearly interpolated percentiles: one row (per ``by``) with an array ``percentiles``."""
    keys = [by] if by else []
    counts = materialize(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    ranked = running_totals(counts, value, ["n"], by)
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    aggs = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= pos) & (pos <= last), F.col(value))).alias(f"{side}{i}"))
    row = ranked.groupBy(*keys).agg(F.max("n_total").alias("n"), *aggs)

    def interpolate(i, p):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return lo + (hi - lo) * (at - F.floor(at))

    return row.select(*keys, F.array(*[interpolate(i, p) for i, p in enumerate(shares)]).alias("percentiles"))


def auc(scored: DataFrame, score: str, positive: Column, by: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null for a single class."""
    keys = [by] if by else []
    counts = materialize(scored.groupBy(*keys, score).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")), "counts")
    ranked = running_totals(counts, score, ["pos", "neg"], by)
    below = F.col("neg_upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    pairs = (F.max("pos_total") * F.max("neg_total")).cast("double")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))
