"""Exact top-k inner products: candidates by descending length, rotated partial sums, residual bounds.

Vectors become integers.  A rotation by the singular vectors of a bounded sample moves most of the
length into the first coordinates; it speeds the search up and never changes a result.  For a query
q and a candidate x the score is at most head(q).head(x) + |tail(q)| |tail(x)|; only pairs whose
bound reaches the query's k-th best score so far are computed, exactly, in integers.

The queries meet the candidates in a grid of cells: a task holds one bounded group of queries and
streams one group of candidates, longest first.  A first pass over the longest candidates gives
every query a score to beat, so the other cells prune from the start.

Vectors whose integers have a length of 2^31 or more are outliers: products with them may pass 63 bits, so
they meet all rows in a second grid, in integers of any size.  A result that does not fit a long is an error.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without an
id take no part; rows with the query's id are its own and no candidates; equal scores go to the smaller
id; vectors of another length are no candidates.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill.llm.common import python_ready
from auditmill.session import materialize

QUERIES_TOGETHER, CANDIDATES_TOGETHER, MOST_TASKS = 1024, 20_000, 100_000
SEED_CANDIDATES, SAMPLE = 2_000, 4_096
WIDE_TOGETHER = 500  # a side of a cell of outliers
PAIRS = 1 << 20  # exact scores computed at a time


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x, length, wide): floor(scale * component) of the vectors that take part.

    ``wide`` holds the components of vectors of length 2^31 or more, whose ``x`` is null; else it is null.
    """
    v = F.transform("v", lambda c: c * scale)
    held = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & held)
    narrow = F.forall(v, lambda c: F.abs(c) < float(1 << 31))
    rows = rows.withColumn("x", F.when(narrow, F.transform(v, lambda c: F.floor(c))))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))
    fits = F.coalesce(F.col("length") < float(1 << 31), F.lit(False))
    return rows.select("vec_id", F.when(fits, F.col("x")).alias("x"), F.when(fits, F.col("length")).alias("length"), F.when(~fits, F.col("v")).alias("wide"))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the right singular vectors of a bounded sample, largest first."""
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("x").collect():
        sample.setdefault(len(r.x), []).append(r.x)
    return {n: np.linalg.svd(np.array(x, np.float64).T @ np.array(x, np.float64))[0] for n, x in sample.items()}


def best(query, score, vec, k: int):
    """The first k of each query, by descending score, then id; the three arrays in that order."""
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return query[rank < k], score[rank < k], vec[rank < k]


class Cell:
    """One group of queries and the best candidates seen so far."""

    def __init__(self, ids, x, to_beat, rotation, k):
        self.ids, self.x, self.k = ids, x, k
        self.head = max(1, x.shape[1] // 4)
        self.rotation = rotation
        self.y = x.astype(np.float64) @ rotation
        self.tail = np.sqrt((self.y[:, self.head:] ** 2).sum(axis=1))
        self.length = np.sqrt((self.y ** 2).sum(axis=1))
        self.limit = to_beat.astype(np.float64)
        self.found = (np.zeros(0, np.int64),) * 3

    def offer(self, ids, x):
        """Candidates, longest first."""
        z = x.astype(np.float64) @ self.rotation
        length = np.sqrt((z ** 2).sum(axis=1))
        room = 1e-9 * (1 + self.length[:, None] * length.max())  # rounding of the rotated sums
        alive = self.length * length.max() + room[:, 0] >= self.limit
        if not alive.any():
            return
        q = np.flatnonzero(alive)
        bound = self.y[q][:, : self.head] @ z[:, : self.head].T + self.tail[q][:, None] * np.sqrt((z[:, self.head:] ** 2).sum(axis=1))
        may = (bound + room[q] >= self.limit[q][:, None]) & (self.ids[q][:, None] != ids)
        i, j = np.nonzero(may)
        if len(i) * 4 > may.size and float(self.length.max()) * float(length.max()) < 2.0 ** 52:
            score = (self.x[q].astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)[i, j]  # exact below 2 ** 53
        else:
            score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", self.x[q[i[a:a + PAIRS]]], x[j[a:a + PAIRS]]) for a in range(0, len(i), PAIRS))])
        good = score >= self.limit[q[i]]
        mine = (q[i[good]], score[good], ids[j[good]])
        self.found = best(*(np.concatenate(p) for p in zip(self.found, mine, strict=True)), self.k)
        at, n = np.unique(self.found[0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == self.k
        self.limit[at[full]] = np.maximum(self.limit[at[full]], self.found[1][last[full]])

    def rows(self):
        q, score, vec = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


def search_cells(rows: DataFrame, rotation: dict[int, np.ndarray], k: int, tasks: int) -> DataFrame:
    """``rows(cell, kind, vec_id, x, length, to_beat)``: in each cell queries (kind 0), then candidates.

    ``tasks`` is stated, as the work of a cell is far larger than its bytes tell.
    """
    sent = rows.sparkSession.sparkContext.broadcast(rotation)  # one square matrix per vector length
    rows = rows.repartition(min(tasks, MOST_TASKS), "cell").sortWithinPartitions("cell", "kind", F.desc("length"), "vec_id")

    def run(batches):
        at, queries, cell = None, [], None
        for batch in batches:
            number, kinds, ids, limit = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "kind", "vec_id", "to_beat"))
            x = batch["x"].to_pylist()
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if number[a] != at:
                    if cell:
                        yield cell.rows()
                    at, queries, cell = number[a], [], None
                part = (ids[a:b], np.array(x[a:b], np.int64), limit[a:b])
                if kinds[a] == 0:
                    queries.append(part)
                    continue
                if not queries:
                    continue
                if cell is None:
                    q = [np.concatenate(p) for p in zip(*queries, strict=True)]
                    cell = Cell(*q, sent.value.get(q[1].shape[1], np.eye(q[1].shape[1])), k)
                cell.offer(part[0], part[1])
        if cell:
            yield cell.rows()

    return python_ready(rows).mapInArrow(run, "query_id long, vec_id long, score long")


def whole_numbers(v, scale: int) -> list[int]:
    """floor(scale * component) at any size; doubles from 2^53 on are whole."""
    return [int(c) * scale if abs(c) >= 2.0 ** 53 else math.floor(c * scale) for c in v]


def search_wide(rows: DataFrame, k: int, scale: int, tasks: int) -> DataFrame:
    """``rows(cell, kind, vec_id, x, wide)``: as ``search_cells``, for pairs with an outlier, without bounds.

    ``over`` tells the sign of a score that does not fit a long.
    """
    rows = rows.repartition(min(tasks, MOST_TASKS), "cell").sortWithinPartitions("cell", "kind", "vec_id")
    top, low = (1 << 63) - 1, -(1 << 63)

    def out(asked, found):
        rows = [(q, vec, min(max(-s, low), top), 0 if low <= -s <= top else 1 if s < 0 else -1) for (q, _, _), best in zip(asked, found) for s, vec in best]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [pa.int32()])],
                                          names=["query_id", "vec_id", "score", "over"])

    def run(batches):
        at, asked, found = None, [], []  # queries, and the best candidates of each
        for batch in batches:
            for cell, kind, vec, x, wide in zip(*(batch[c].to_pylist() for c in ("cell", "kind", "vec_id", "x", "wide"))):
                if cell != at:
                    if asked:
                        yield out(asked, found)
                    at, asked, found = cell, [], []
                y = x if x is not None else whole_numbers(wide, scale)
                if kind == 0:
                    asked.append((vec, y, x is None))
                    found.append([])
                    continue
                for (q, z, is_wide), best in zip(asked, found):
                    if q != vec and (is_wide or x is None):  # pairs without an outlier are the first grid's
                        best.append((-sum(a * b for a, b in zip(y, z)), vec))
                        if len(best) > 8 * k:
                            best[:] = heapq.nsmallest(k, best)
            found = [heapq.nsmallest(k, best) for best in found]
        if asked:
            yield out(asked, found)

    return python_ready(rows).mapInArrow(run, "query_id long, vec_id long, score long, over int")


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(*([F.desc("over")] if "over" in found.columns else []), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str | Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id, as SQL
    or made of ``F.col``.  Repeated query ids
    are one query (that of the smaller vector, one that is no outlier first).
    """
    every = materialize(integers(vectors.select("vec_id", "embedding"), scale).withColumn("dim", F.size(F.coalesce(F.col("x").cast("array<double>"), "wide"))), "integers")
    all_queries = every.filter(is_query).groupBy("vec_id").agg(F.min(F.struct(F.col("x").isNull(), "x", "length", "dim", "wide")).alias("r")).select("vec_id", "r.x", "r.length", "r.dim", "r.wide")
    rows, queries = every.filter("wide is null").drop("wide"), all_queries.filter("wide is null").drop("wide")
    n_queries, n_rows, n_wide = queries.count(), rows.count(), every.filter("wide is not null").count()
    q_groups, c_groups = 1 + n_queries // QUERIES_TOGETHER, 1 + n_rows // CANDIDATES_TOGETHER
    rotation = rotations(rows)
    lowest = F.lit(float("-inf"))

    def cells(asked: DataFrame, base: DataFrame, groups: int) -> DataFrame:
        other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(q_groups))).withColumn("cg", other(groups)).withColumn("kind", F.lit(0))
        right = base.withColumns({"cg": F.pmod(F.xxhash64("vec_id"), F.lit(groups)), "kind": F.lit(1), "to_beat": lowest}).withColumn("qg", other(q_groups))
        return left.unionByName(right).select(F.xxhash64("dim", "qg", "cg").alias("cell"), "kind", "vec_id", "x", "length", "to_beat")

    longest = rows.orderBy(F.desc("length"), "vec_id").limit(SEED_CANDIDATES)
    seed = first_k(search_cells(cells(queries.withColumn("to_beat", lowest), longest, 1), rotation, k, q_groups), k)
    beat = materialize(seed.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("s")), "seed")
    asked = queries.join(beat, F.col("vec_id") == F.col("q"), "left").select("vec_id", "x", "length", "dim", F.coalesce("s", lowest).alias("to_beat"))
    found = first_k(search_cells(cells(asked, rows, c_groups), rotation, k, q_groups * c_groups), k)
    if n_wide:
        def outlier_cells(asked: DataFrame, base: DataFrame) -> tuple[DataFrame, int]:
            qn, cn = 1 + asked.count() // WIDE_TOGETHER, 1 + base.count() // WIDE_TOGETHER
            other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            left = asked.withColumn("qg", F.pmod(F.xxhash64("vec_id"), F.lit(qn))).withColumn("cg", other(cn)).withColumn("kind", F.lit(0))
            right = base.withColumns({"cg": F.pmod(F.xxhash64("vec_id"), F.lit(cn)), "kind": F.lit(1)}).withColumn("qg", other(qn))
            return left.unionByName(right).select(F.xxhash64("dim", "qg", "cg").alias("cell"), "kind", "vec_id", "x", "wide"), qn * cn

        no_wide = rows.withColumn("wide", F.lit(None).cast("array<double>"))
        outliers = every.filter("wide is not null")
        found = found.select("query_id", "vec_id", "score", F.lit(0).alias("over"))
        for asked_too, base in ((all_queries, outliers), (all_queries.filter("wide is not null"), no_wide)):
            grid, tasks = outlier_cells(asked_too, base)
            found = found.unionByName(search_wide(grid, k, scale, tasks))
        found = first_k(found, k)
        found = found.withColumn("score", F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 63 bits")).cast("long")))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
