"""Near-duplicate vectors through a pivot-permutation index, with exact verification.

Reference points (a bounded sample of the vectors) order every vector: its nearest ``nearest``
pivots are its description.  Two vectors are candidates if they share at least ``shared`` of them,
that is, if they meet in an inverted list of ``shared`` pivots.  Every vector is indexed.

Vectors with the same nearest pivots gather in balls: what lies within half the threshold's angle
of the ball's centre is linked with all of the ball, by the triangle inequality, so a large group
of copies is never compared pair by pair.  Two balls are decided by the angle of their centres and
their radii where that suffices; else their members are compared, in blocks.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
without an id, link with nothing; equal vectors are links of each other; rows that repeat an id
count as vectors of their own; vectors of different lengths are never linked.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditmill.llm.common import components, python_ready, runs
from auditmill.session import materialize

BLOCK = 512
SLACK = 1e-6  # radians: closer to a border than this is verified


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): unit vectors as binaries of doubles, for the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch["x"].to_pylist():
                v = np.array(v)
                v = v / np.abs(v).max()  # squares of very large or small components stay finite
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return python_ready(rows).mapInArrow(run, "vec_id long, unit binary")


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def describe(rows: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Add ``near`` (pivot numbers, nearest first) and ``cell`` (a number for the set of them)."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # as many as the caller asked for

    def run(batches):
        for batch in batches:
            near = []
            for u in batch["unit"].to_pylist():
                u = np.frombuffer(u, np.float64)
                p = sent.value[len(u)]
                # rounded, so that equal vectors are described alike whatever the order of summation
                near.append(np.lexsort((np.arange(len(p)), -np.round(p @ u, 12)))[:nearest])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["unit"], pa.array(near, pa.list_(pa.int64()))], names=["vec_id", "unit", "near"])

    return python_ready(rows).mapInArrow(run, "vec_id long, unit binary, near array<long>").withColumn(
        "cell", F.xxhash64(F.octet_length("unit"), F.array_sort("near")))


def in_blocks(rows: DataFrame, by: list[str], size: DataFrame, ident: str, wide: DataFrame) -> DataFrame:
    """Deal each group of ``rows`` to blocks of about ``BLOCK`` and those to pairs of blocks (lo, hi), own block in ``own``.

    The columns of ``wide`` are joined by ``ident`` only to the rows that are dealt.
    """
    n = F.ceil(F.col("_size") / BLOCK)
    dealt = rows.join(size, by).withColumn("own", F.pmod(F.xxhash64(ident), n)).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    cells = dealt.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_size", "_other").join(wide, ident)
    return cells.repartition(*by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi")


def ball_pairs(balls: DataFrame, shared: int, theta: float) -> DataFrame:
    """Pairs of balls in a common inverted list that are linked (``sure``: all members) or may be."""
    keys = list(combinations(range(16), shared))

    def key_columns(near_size):
        return [F.xxhash64(F.col("dim"), *[F.col("sorted")[i] for i in c]) for c in keys if max(c) < near_size]

    near_size = balls.select(F.max(F.size("near"))).first()[0] or 0
    if near_size < 1:
        return balls.sparkSession.createDataFrame([], "a long, b long, sure boolean")
    # short descriptions (fewer pivots than asked for) meet on all they have
    short = F.xxhash64(F.col("dim"), F.lit("short"))
    listed = balls.withColumn("sorted", F.concat(F.array_sort("near"), F.array_repeat(F.lit(-1).cast("long"), 16)))
    lists = F.when(F.size("near") < shared, F.array(short)).otherwise(F.array_distinct(F.array(*(key_columns(near_size) or [short]))))
    rows = listed.select("ball", F.explode(lists).alias("list"))
    size = rows.groupBy("list").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")

    def run(batches):
        for (_, lo, hi), t in runs(batches, ["list", "lo", "hi"]):
            own, ball, radius = (t[c].to_numpy() for c in ("own", "ball", "radius"))
            unit = matrix(t["unit"])
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            apart = angles(unit[left], unit[right])
            reach = radius[left][:, None] + radius[right]
            may = apart - reach <= theta + SLACK
            may &= (ball[left][:, None] < ball[right]) if lo == hi else (ball[left][:, None] != ball[right])
            i, j = np.nonzero(may)
            sure = (apart + reach)[i, j] <= theta - SLACK
            a, b = ball[left[i]], ball[right[j]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], names=["a", "b", "sure"])

    return python_ready(in_blocks(rows, ["list"], size, "ball", balls.select("ball", "radius", "unit"))).mapInArrow(run, "a long, b long, sure boolean").distinct()


def compare_members(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """Links between the members of undecided pairs of balls: (a, b, row, n), counted per member and block."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("ball")), F.struct(F.lit(1).alias("side"), F.col("b").alias("ball")))).alias("s"))
    rows = sides.select("a", "b", "s.side", "s.ball").join(members.select("ball", "row"), "ball").select("a", "b", "side", "row")
    size = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_size"))

    def run(batches):
        for (a, b, lo, hi), t in runs(batches, ["a", "b", "lo", "hi"]):
            own, side, row = (t[c].to_numpy() for c in ("own", "side", "row"))
            unit, found = matrix(t["unit"]), {}
            for x, y in {(lo, hi), (hi, lo)}:
                left, right = np.flatnonzero((own == x) & (side == 0)), np.flatnonzero((own == y) & (side == 1))
                if len(left) and len(right):
                    linked = unit[left] @ unit[right].T >= cosine
                    for ids, n in ((row[left], linked.sum(axis=1)), (row[right], linked.sum(axis=0))):
                        for k, c in zip(ids[n > 0].tolist(), n[n > 0].tolist(), strict=True):
                            found[k] = found.get(k, 0) + c
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(found)), pa.array([b] * len(found)), pa.array(list(found)), pa.array(list(found.values()))], names=["a", "b", "row", "n"])

    return python_ready(in_blocks(rows, ["a", "b"], size, "row", members.select("row", "unit"))).mapInArrow(run, "a long, b long, row long, n long")


def reference_points(sample: list[np.ndarray], dim: int, n: int, theta: float) -> np.ndarray:
    """``n`` directions: those of the sample that are far from each other, then random ones.

    Points of one group of copies would be equally near to all its members, and which of them
    come first would be chance.
    """
    kept = np.zeros((0, dim))
    for u in sample:
        if len(kept) < n and (not len(kept) or (kept @ u).max() < np.cos(2 * theta)):
            kept = np.vstack([kept, u])
    more = np.random.default_rng(dim).normal(size=(n - len(kept), dim))
    return np.vstack([kept, more / np.linalg.norm(more, axis=1)[:, None]])


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, pivots: int = 512, nearest: int = 7, shared: int = 3) -> DataFrame:
    """One row for each row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    The index is fitted on a sample of ``4 * pivots`` vectors (those with the smallest hashes);
    ``pivots`` bounds what is broadcast; raise it with the table, as lists get shorter with its power
    ``shared``.
    """
    theta = float(np.arccos(cosine))
    base = units(vectors)
    sample = base.orderBy(F.xxhash64("unit"), "vec_id").limit(4 * pivots).select("unit").collect()
    points: dict[int, list] = {}
    for r in sample:
        points.setdefault(len(r.unit) // 8, []).append(np.frombuffer(r.unit, np.float64))
    lengths = [r[0] for r in base.select((F.octet_length("unit") / 8).cast("int")).distinct().collect()]
    known = {n: reference_points(points.get(n, []), n, pivots, theta) for n in lengths}
    rows = materialize(describe(base, known, nearest).withColumn("row", F.monotonically_increasing_id()), "described")

    heads = rows.groupBy("cell").agg(F.min("vec_id").alias("head"), F.min_by("unit", "vec_id").alias("centre"))
    met = rows.join(heads, "cell")

    def place(batches):
        for batch in batches:
            a, b = batch["unit"].to_pylist(), batch["centre"].to_pylist()
            angle = np.array([np.arccos(np.clip(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64), -1, 1)) if x != y else 0.0 for x, y in zip(a, b, strict=True)])
            inside = angle <= theta / 2 - SLACK
            # a row outside is a ball of its own; its number is negative and not an id, as ids may repeat
            ball = np.where(inside, batch["head"].to_numpy(), -1 - batch["row"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], batch["unit"], batch["near"], batch["cell"], pa.array(ball), pa.array(np.where(inside, angle, 0.0))],
                                             names=["row", "vec_id", "unit", "near", "cell", "ball", "angle"])

    placed = python_ready(met.select("row", "vec_id", "unit", "near", "cell", "head", "centre")).mapInArrow(
        place, "row long, vec_id long, unit binary, near array<long>, cell long, ball long, angle double")
    # an id may head several cells when it repeats: balls are numbered per cell
    members = materialize(placed.withColumn("ball", F.xxhash64("cell", "ball")), "members")
    balls = materialize(members.groupBy("ball").agg(
        F.count(F.lit(1)).alias("m"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"),
        F.min_by("unit", F.struct("angle", "vec_id")).alias("unit"), F.first("near").alias("near"),
        F.first(F.octet_length("unit")).alias("dim")), "balls")
    pairs = materialize(ball_pairs(balls, shared, theta), "pairs")
    checked = materialize(compare_members(pairs.filter("not sure"), members.select("ball", "row", "unit"), cosine), "checked")

    sure = pairs.filter("sure")
    both = sure.select("a", "b").unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = both.join(balls.select(F.col("ball").alias("b"), "m"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("m").alias("more"))
    single = checked.groupBy("row").agg(F.sum("n").alias("some"))
    linked = sure.select("a", "b").unionByName(checked.select("a", "b")).distinct()
    named = balls.join(components(linked), F.col("ball") == F.col("node"), "left").withColumn("component", F.coalesce("component", "ball"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_ball = named.join(least, "component").join(whole, "ball", "left").select("ball", "component_id", (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("inside"))
    found = members.select("row", "vec_id", "ball").join(per_ball, "ball").join(single, "row", "left").select(
        "vec_id", (F.col("inside") + F.coalesce("some", F.lit(0))).alias("n_links"), "component_id")

    x = F.col("embedding").cast("array<double>")
    takes_part = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rest = vectors.filter(~(takes_part & F.col("vec_id").isNotNull())).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
