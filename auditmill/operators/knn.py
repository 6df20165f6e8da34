"""Exact k nearest neighbours over a stored metric index.

The index is a table.  Points are assigned to the nearest of a bounded number of pivots; a cell is cut
into rings by the distance to its pivot, a ring into blocks of bounded size.  Files are stored by cell, and
the radii of every ring are stored beside them.  An index is fitted once and read by any number of
searches (``MetricIndex.fit``, ``MetricIndex.load``).

A search bounds every single query point before any vector moves: the distances to the pivots and the radii
give a lower bound of all distances in a ring.  First the closest rings that surely hold enough points are
compared, which gives the query a k-th distance; then only the rings that reach into that ball.  Queries are
dealt to ``CHUNKS`` chunks, neighbours of one cell together; a task holds some chunks with the best that was
found so far, and a part of the points of the rings that its queries ask for stream past it once.  Neighbouring chunks
are held together and the points are dealt to as many parts, as far as that moves less (``grid``): a point moves at most
once for each group of chunks, a query once for each part, and the best of the parts are merged.  Chunks only grow in
number where ``QUERIES_TOGETHER`` queries or ``FOUND_TOGETHER`` neighbours bound them.  Chunks whose points are more than
``MOVED_TOGETHER`` numbers are compared in waves, and what moved in a wave is removed before the next one, so the disk
holds a wave and not the whole of (points x chunks).  Folders of cells that nobody asks for are not read.  In high dimensions little can be pruned; the answer stays exact and the work is spread evenly.

Equal vectors are compared once: points keep the ``most`` smallest ids per distinct vector (no other
copy can be among so many nearest), queries are compared per distinct vector and joined back.
Ties are broken by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from auditmill.session import freed, keep as kept, materialize, ship_package, step_path, write_table

MAX_CELLS = 1024       # bounds what is held of the pivots
MAX_RINGS = 16         # of a cell, so MAX_CELLS * MAX_RINGS rings have radii
POINTS_PER_CELL = 2048
BLOCK_ROWS = 2048
CHUNKS = 24            # of queries, where there are enough
LEAST_TOGETHER = 512   # queries of a chunk, unless a bound below asks for fewer
QUERIES_TOGETHER = 65_536
FOUND_TOGETHER = 1 << 21  # neighbours that a chunk holds
ASKS_TOGETHER = 1 << 27   # (query, ring) pairs of a chunk
MOVED_TOGETHER = 1 << 27  # numbers of the points that move at once
MOST = 64
RINGS = ("cell", "ring", "n", "blocks", "lo", "hi")


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _unit(x: np.ndarray, role: str) -> np.ndarray:
    """Unit vectors in two more dimensions, where zero vectors are orthogonal to all others."""
    size = np.sqrt((x * x).sum(1))
    out = np.zeros((x.shape[0], x.shape[1] + 2))
    some = size > 0
    out[some, :-2] = x[some] / size[some, None]
    out[~some, -2 if role == "query" else -1] = 1.0
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(x.shape[0] + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _by_vector(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with the ``rep`` of their ``vec``."""
    hashed = lambda df: df.withColumn("h", F.xxhash64("vec"))  # noqa: E731  cheap to sort by
    return hashed(rows).join(hashed(wanted.select("vec", "rep")), ["h", "vec"]).drop("h")


def known_vectors(df: DataFrame, id_col: str, name: str, vector: str) -> DataFrame:
    """(name, vec) of the rows whose vector has only finite components."""
    rows = df.select(F.col(id_col).alias(name), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter((F.size("vec") > 0) & finite)


def grid(points: int, asked: int, queries: int, chunks: int, most: int, tasks: int | None = None) -> tuple[int, int]:
    """(chunks held together, parts of the points): what moves the fewest rows in no fewer tasks.

    A point moves once for each group of chunks that asks for it, a query once for each part; ``asked`` is how many points
    the chunks ask for in all.  A group has ``most`` queries at most.  Chunks that are only a wave of all still make ``tasks``.
    """
    tasks, ways = tasks or min(chunks, CHUNKS), []
    for together in range(1, chunks + 1):
        if together > 1 and together * -(-queries // chunks) > most:
            break
        groups = -(-chunks // together)
        parts = -(-tasks // groups)
        ways.append((min(points * groups, asked) + queries * parts, together, parts))
    return min(ways)[1:]


class Bounds:
    """Pivots and ring radii, as the tasks hold them."""

    def __init__(self, pivots: np.ndarray, rings: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.cell, self.ring, self.n, self.blocks = (rings[:, i].astype(np.int64) for i in range(4))
        self.lo, self.hi = rings[:, 4], rings[:, 5]

    def points(self, vec: pa.Array, role: str) -> np.ndarray:
        x = _matrix(vec)
        return _unit(x, role) if self.metric == "cosine" else x

    def wanted(self, x: np.ndarray, keep: int, limit: np.ndarray | None) -> np.ndarray:
        """Which rings each point of ``x`` asks for: without ``limit`` the closest that hold ``keep`` points,
        with it all that reach into the ball of that radius."""
        out = np.zeros((len(x), len(self.ring)), bool)
        step = max(1, (1 << 20) // len(self.ring))  # bounds the distances that are held
        for a in range(0, len(x), step):
            out[a:a + step] = self._wanted(x[a:a + step], keep, None if limit is None else limit[a:a + step])
        return out

    def _wanted(self, x: np.ndarray, keep: int, limit: np.ndarray | None) -> np.ndarray:
        to_pivot = _distances(x, self.pivots)
        to_cell = to_pivot[:, self.cell]
        slack = 1e-6 * (1.0 + to_cell)  # rounding of the distances
        least = np.maximum.reduce([to_cell - self.hi, self.lo - to_cell, (to_cell - to_pivot.min(1)[:, None]) / 2, np.zeros_like(to_cell)]) - slack
        order = np.argsort(least, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, before < keep, axis=1)
        if limit is None:
            return first
        most = np.sort(np.where(first, to_cell + self.hi + slack, -np.inf), axis=1)[:, -1]
        return least <= np.minimum(limit, most)[:, None]


class MetricIndex:
    """A fitted index; see the module.  ``most`` limits the k that can be searched."""

    def __init__(self, spark: SparkSession, path: str, about: pa.Table):
        self.spark, self.path = spark, path
        self.metric, self.most, self.id_type = (about[c][0].as_py() for c in ("metric", "most", "id_type"))
        rings, pivots = about.filter(pc.is_valid(about["ring"])), about.filter(pc.is_valid(about["pivot"]))
        self.empty = not len(pivots)
        if not self.empty:
            self.bounds = Bounds(_matrix(pivots.sort_by("cell")["pivot"].combine_chunks()), np.stack([rings[c].to_numpy().astype(float) for c in RINGS], axis=1), self.metric)
            self.size = self.bounds.pivots.shape[1] - (2 if self.metric == "cosine" else 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MetricIndex:
        """A stored index; at most MAX_CELLS pivots and MAX_CELLS * MAX_RINGS radii are read."""
        return cls(spark, path, spark.read.parquet(f"{path}/bounds").toArrow())

    @classmethod
    def fit(cls, base: DataFrame, id_col: str = "id", vector: str = "vector", metric: str = "euclidean", most: int = MOST,
            path: str | None = None, block_rows: int = BLOCK_ROWS, points_per_cell: int = POINTS_PER_CELL) -> MetricIndex:
        """Write an index of ``base``; ``metric`` is ``euclidean`` or ``cosine`` (distance = 1 - cosine).

        Rows whose vector is null, empty or holds null or non-finite components take no part, nor do
        vectors of another length than the most frequent one.
        """
        spark = base.sparkSession
        ship_package(spark)
        path = path or step_path(spark, "metric-index")
        with freed(spark):
            return cls(spark, path, cls._written(base, id_col, vector, metric, most, path, block_rows, points_per_cell))

    @classmethod
    def _written(cls, base: DataFrame, id_col: str, vector: str, metric: str, most: int, path: str, block_rows: int, points_per_cell: int) -> pa.Table:
        """Write the index below ``path``; pivots and radii as they are stored."""
        spark = base.sparkSession
        copies = Window.partitionBy("vec").orderBy("id")
        points = materialize(
            known_vectors(base, id_col, "id", vector).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= most)
            .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
        sizes = points.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
        id_type = points.schema["ids"].dataType.elementType.simpleString()
        rings, pivots = pa.table({c: pa.array([], pa.float64()) for c in RINGS}), np.zeros((0, 1))
        if sizes:
            n, points = sizes["n"], points.filter(F.size("vec") == sizes["size"])
            cells = max(1, min(MAX_CELLS, n // points_per_cell))
            if n <= block_rows:  # one block, whatever its radius
                pivots = np.zeros((1, sizes["size"] + (2 if metric == "cosine" else 0)))
                rings = pa.table({c: [float(v)] for c, v in zip(RINGS, (0, 0, n, 1, 0, np.inf), strict=True)})
                stored = cls._in_cells(points, pivots, metric, id_type).withColumns({"ring": F.lit(0), "block": F.lit(0).cast("long")})
            else:
                sample = points.orderBy(F.xxhash64("vec")).select("vec").limit(cells).toArrow()["vec"].combine_chunks()
                pivots = _unit(_matrix(sample), "base") if metric == "cosine" else _matrix(sample)
                placed = cls._in_rings(materialize(cls._in_cells(points, pivots, metric, id_type), "cells"), block_rows)
                n = F.count(F.lit(1))
                rings = placed.groupBy("cell", "ring").agg(
                    n.alias("n"), F.ceil(n / block_rows).alias("blocks"), F.min("to_pivot").alias("lo"), F.max("to_pivot").alias("hi")).toArrow()
                blocks = F.broadcast(spark.createDataFrame(rings).select("cell", "ring", "blocks"))  # MAX_CELLS * MAX_RINGS rows
                stored = placed.join(blocks, ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks"))).repartition(
                    "cell", "ring", "block").sortWithinPartitions("cell", "ring", "block")
            write_table(stored.select("cell", "ring", "block", "ids", "point"), f"{path}/points", by="cell")
        size = max(len(pivots), 1)  # an empty index is a row without a pivot
        about = pa.table({"cell": pa.array(range(size), pa.int64()), "pivot": pa.array(pivots.tolist() or [None], pa.list_(pa.float64()))})
        rings = rings.cast(pa.schema([(c, pa.float64() if c in ("lo", "hi") else pa.int64()) for c in RINGS]))
        about = pa.concat_tables([about, rings], promote_options="default")
        for name, value in (("metric", metric), ("most", most), ("id_type", id_type)):
            about = about.append_column(name, pa.array([value] * len(about)))
        spark.createDataFrame(about).coalesce(1).write.parquet(f"{path}/bounds")
        return about

    @staticmethod
    def _in_cells(points: DataFrame, pivots: np.ndarray, metric: str, id_type: str) -> DataFrame:
        """The point that is compared, its nearest pivot and the distance to it."""
        def run(batches):
            for batch in batches:
                x = _matrix(batch["vec"]) if batch.num_rows else np.zeros((0, 1))
                x = _unit(x, "base") if metric == "cosine" else x
                if not len(x):
                    continue
                d = _distances(x, pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([
                    batch["ids"], _lists(x), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], names=["ids", "point", "cell", "to_pivot"])

        return points.select("ids", "vec").mapInArrow(run, f"ids array<{id_type}>, point array<double>, cell int, to_pivot double")

    @staticmethod
    def _in_rings(held: DataFrame, block_rows: int) -> DataFrame:
        """Add ``ring``: large cells are cut at quantiles of the distance to the pivot."""
        shares = F.array(*[F.lit(i / MAX_RINGS) for i in range(1, MAX_RINGS)])
        cells = held.groupBy(F.col("cell").alias("_cell")).agg(
            F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(MAX_RINGS)).cast("int").alias("rings"), F.percentile_approx("to_pivot", shares, 1000).alias("at"))
        cut = F.when(F.col("rings") > 1, F.transform(F.sequence(F.lit(1), F.col("rings") - 1), lambda j: F.get(
            F.col("at"), F.floor(j * MAX_RINGS / F.col("rings")).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
        cells = F.broadcast(cells.select("_cell", cut.alias("cuts")))  # MAX_CELLS rows
        joined = held.join(cells, F.col("cell") == F.col("_cell"))
        return joined.withColumn("ring", F.size(F.filter("cuts", lambda c: F.col("to_pivot") > c))).drop("_cell", "cuts")

    # --- search ---------------------------------------------------------------

    def asked(self, wanted: DataFrame, keep: int) -> DataFrame:
        """(chunk, cell, ring, times): how many of the queries ``wanted(rep, vec, limit, chunk)`` ask for each ring.

        Nothing but the query points themselves is needed for it.  Without a chunk all are in one.
        """
        bounds = self.bounds

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                limit, chunk = (batch[c].to_numpy(zero_copy_only=False) for c in ("limit", "chunk"))
                asks = bounds.wanted(bounds.points(batch["vec"], "query"), keep, None if np.isnan(limit).all() else limit)
                for c in np.unique(chunk):
                    times = asks[chunk == c].sum(0)
                    some = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c)), pa.array(bounds.cell[some]), pa.array(bounds.ring[some]), pa.array(times[some].astype(np.int64))],
                                                     names=["chunk", "cell", "ring", "times"])

        if "chunk" not in wanted.columns:
            wanted = wanted.withColumn("chunk", F.lit(0))
        rows = wanted.select("vec", "limit", F.col("chunk").cast("long").alias("chunk"))
        return rows.mapInArrow(run, "chunk long, cell long, ring long, times long").groupBy("chunk", "cell", "ring").agg(F.sum("times").alias("times"))

    def _most(self, keep: int) -> int:
        """The queries that a task may hold."""
        return max(1, min(QUERIES_TOGETHER, FOUND_TOGETHER // keep, ASKS_TOGETHER // len(self.bounds.ring)))

    def _dealt(self, vectors: DataFrame, keep: int) -> tuple[DataFrame, int]:
        """The distinct query vectors ``(vec)`` with ``rep`` and ``chunk``, and the number of chunks; those of a cell are together."""
        bounds = self.bounds

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    home = _distances(bounds.points(batch["vec"], "query"), bounds.pivots).argmin(1)
                    yield pa.RecordBatch.from_arrays([batch["rep"], batch["vec"], pa.array(home)], names=["rep", "vec", "home"])

        placed = materialize(vectors.withColumn("rep", F.monotonically_increasing_id()).select("rep", "vec").mapInArrow(run, "rep long, vec array<double>, home long"), "queries")
        sizes = placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).orderBy("home").toArrow()  # MAX_CELLS rows
        n = sizes["n"].to_numpy()
        total = int(n.sum())
        rows = max(LEAST_TOGETHER, -(-total // CHUNKS))
        rows = min(rows, self._most(keep))
        starts = F.broadcast(self.spark.createDataFrame(sizes.append_column("start", pa.array(np.cumsum(n) - n))))
        place = F.col("start") + F.pmod(F.xxhash64("rep"), F.col("n"))
        return placed.join(starts, "home").select("rep", "vec", F.floor(place / rows).cast("long").alias("chunk")), -(-total // rows)

    def _moved(self, wanted: DataFrame, chunks: int, keep: int, asks: DataFrame | None = None, tasks: int | None = None) -> tuple[DataFrame, int, int]:
        """The rows that meet in tasks, by group of chunks and part, and the numbers of these: queries, then the points of the rings they ask for."""
        asks = materialize(self.asked(wanted, keep), "asks") if asks is None else asks
        times = asks.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()  # MAX_CELLS * MAX_RINGS rows at most
        cells = sorted({r.cell for r in times})
        held = dict(zip(zip(self.bounds.cell.tolist(), self.bounds.ring.tolist(), strict=True), self.bounds.n.tolist(), strict=True))
        together, parts = grid(sum(held.values()), sum(held[r.cell, r.ring] * r.n for r in times), wanted.count(), chunks, self._most(keep), tasks)
        group, none, zero = F.floor(F.col("chunk") / together).alias("group"), F.lit(None), F.lit(0).cast("long")
        points = self.spark.read.parquet(f"{self.path}/points").filter(F.col("cell").isin(cells)).select(
            F.col("cell").cast("long").alias("cell"), F.col("ring").cast("long").alias("ring"), "point", "ids", F.pmod(F.xxhash64("point"), F.lit(parts)).alias("part"))
        points = points.join(asks.select(group, "cell", "ring").distinct(), ["cell", "ring"]).select(
            "group", "part", F.lit(1).alias("kind"), "cell", "ring", none.cast("long").alias("rep"), "point", none.cast("double").alias("limit"), "ids")
        each = F.explode(F.sequence(zero, F.lit(parts - 1).cast("long"))).alias("part")
        queries = wanted.select(group, each, F.lit(0).alias("kind"), zero.alias("cell"), zero.alias("ring"), "rep", F.col("vec").alias("point"), "limit", none.cast(f"array<{self.id_type}>").alias("ids"))
        return queries.unionByName(points), -(-chunks // together), parts

    def _waves(self, asks: DataFrame, chunks: int) -> list[range]:
        """The chunks that are compared at once: as many as ask for ``MOVED_TOGETHER`` numbers in all, one at least."""
        b = self.bounds
        rings = self.spark.createDataFrame(pa.table({"cell": b.cell, "ring": b.ring, "n": b.n}))
        asked = asks.join(F.broadcast(rings), ["cell", "ring"]).groupBy("chunk").agg((F.sum("n") * b.pivots.shape[1]).alias("numbers")).collect()
        numbers, first, moved, waves = {r.chunk: r.numbers for r in asked}, 0, 0, []
        for chunk in range(chunks):
            moved += numbers.get(chunk, 0)
            if moved > MOVED_TOGETHER and chunk > first:
                waves.append(range(first, chunk))
                first, moved = chunk, numbers.get(chunk, 0)
        return [*waves, range(first, chunks)]

    def _compared(self, wanted: DataFrame, chunks: int, keep: int, path: str | None = None) -> DataFrame:
        """(rep, ids, distances): for every query of ``wanted(rep, vec, chunk, limit)`` the best ``keep`` of the rings it asks for, nearest first.

        Written to ``path`` if one is given."""
        asks = materialize(self.asked(wanted, keep), "asks")
        waves = self._waves(asks, chunks)
        if len(waves) == 1 and not path:
            return self._wave(wanted, asks, chunks, keep)
        path = path or step_path(self.spark, "found")
        for wave in waves:
            queries, rings = (df.filter(F.col("chunk").between(wave[0], wave[-1])).withColumn("chunk", F.col("chunk") - wave[0]) for df in (wanted, asks))
            found = self._wave(queries, rings, len(wave), keep, min(chunks, CHUNKS))
            write_table(found, path, "append")
        return self.spark.read.schema(found.schema).parquet(path)

    def _wave(self, wanted: DataFrame, asks: DataFrame, chunks: int, keep: int, tasks: int | None = None) -> DataFrame:
        """``_compared`` for chunks numbered from 0, all at once in ``tasks``."""
        bounds = self.bounds
        moved, groups, parts = self._moved(wanted, chunks, keep, asks, tasks)
        key = ["group", "part", "kind", "cell", "ring"]
        # several partitions for a task's rows, so that few of them meet in one
        rows = moved.repartition(4 * groups * parts, "group", "part").sortWithinPartitions(*key)
        number = {at: i for i, at in enumerate(zip(bounds.cell.tolist(), bounds.ring.tolist(), strict=True))}

        def run(batches):
            at, held = None, None
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                place = np.stack([batch[c].to_numpy() for c in key])
                cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part, (*home, kind, cell, ring) = batch.slice(a, b - a), place[:, a].tolist()
                    if home != at:
                        if isinstance(held, Chunk):
                            yield from held.told()
                        at, held = home, []
                    if kind == 0:
                        held.append(part)
                        continue
                    if isinstance(held, list):
                        held = Chunk(held, bounds, keep)
                    held.meet(number[cell, ring], part)
            if isinstance(held, Chunk):
                yield from held.told()

        found = rows.mapInArrow(run, f"rep long, ids array<{self.id_type}>, distances array<double>")
        if parts == 1:
            return found
        best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("distances", "ids")))), 1, keep)  # parts x keep
        return found.groupBy("rep").agg(best.alias("b")).select("rep", F.col("b.ids").alias("ids"), F.col("b.distances").alias("distances"))

    def search(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
        """``query_id, neighbor_id, distance, rank`` of the ``k`` nearest points per query.

        ``exclude_self`` leaves out the point with the query's own id.  A query whose vector could not
        be a point has no neighbours.
        """
        keep = k + (1 if exclude_self else 0)
        if keep > self.most:
            raise ValueError(f"the index holds {self.most} copies of a point, {keep} are asked for")
        q_all = known_vectors(queries, id_col, "query_id", vector)
        if self.empty:
            kind = q_all.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, neighbor_id {self.id_type}, distance double, rank int")
        ship_package(self.spark)
        q_all = q_all.filter(F.size("vec") == self.size)
        return self._told(q_all, *self._searched(q_all.select("vec").distinct(), keep), k, exclude_self)

    def _searched(self, vectors: DataFrame, keep: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The distinct query vectors ``(rep, vec, chunk)`` and ``(rep, ids, distances)`` of the best ``keep`` of each, in ``path`` if one is given."""
        wanted, chunks = self._dealt(vectors, keep)
        if len(self.bounds.ring) == 1:
            limited = wanted.withColumn("limit", F.lit(float("inf")))
        else:
            near = self._compared(wanted.withColumn("limit", F.lit(float("nan"))), chunks, keep)
            ball = F.when(F.size("distances") >= keep, F.element_at("distances", -1)).otherwise(F.lit(float("inf")))
            near = near.select(F.col("rep").alias("_rep"), ball.alias("_limit"))
            limited = materialize(wanted.join(near, F.col("rep") == F.col("_rep"), "left").select(
                "rep", "vec", "chunk", F.coalesce("_limit", F.lit(float("inf"))).alias("limit")), "balls")
        # only the rings that the ball reaches into
        return wanted, self._compared(limited, chunks, keep, path)

    def nearest(self, rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
        """``(rep, ids, distances)`` of the ``keep`` nearest points of every distinct ``vec`` of ``rows``, and ``rows`` with
        ``rep`` for ``vec``; both written.  Rows whose vector could not be a point are left out."""
        ship_package(self.spark)
        rows = rows.filter(F.size("vec") == self.size)
        path = step_path(self.spark, "nearest")
        with freed(self.spark):
            wanted, best = self._searched(rows.select("vec").distinct(), keep, path)
            return best, kept(_by_vector(rows, wanted).drop("vec"), "named")

    def _told(self, q_all: DataFrame, wanted: DataFrame, best: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The neighbours of every query, from those of its vector."""
        found = _by_vector(q_all, wanted).select("query_id", "rep").join(best, "rep").select("query_id", F.explode(F.arrays_zip("ids", "distances")).alias("f")).select(
            "query_id", F.col("f.ids").alias("neighbor_id"), F.col("f.distances").alias("distance"))
        if exclude_self:
            found = found.filter(F.col("query_id") != F.col("neighbor_id"))
        mine = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        if self.metric == "cosine":
            found = found.withColumn("distance", F.col("distance") * F.col("distance") / 2)
        return found.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)


class Chunk:
    """The queries that a task holds and the best ``keep`` that were found for each so far."""

    ROWS, POINTS, PAIRS = 1024, 2048, 1 << 16  # compared at once

    def __init__(self, parts: list[pa.RecordBatch], bounds: Bounds, keep: int):
        self.rep = np.concatenate([p["rep"].to_numpy() for p in parts])
        self.x = np.concatenate([bounds.points(p["point"], "query") for p in parts])
        limit = np.concatenate([p["limit"].to_numpy(zero_copy_only=False) for p in parts])
        self.keep, self.size = keep, (self.x * self.x).sum(1)
        self.asks = bounds.wanted(self.x, keep, None if np.isnan(limit).all() else limit)
        self.bound = np.where(np.isnan(limit), np.inf, limit)  # no smaller than the keep-th distance
        self.found, self.more, self.kind = [], 0, None

    def meet(self, ring: int, part: pa.RecordBatch) -> None:
        """Compare points of a ring with the queries that ask for it."""
        lists = pa.concat_arrays([part["ids"]])  # offsets that begin at 0
        self.kind = lists.type.value_type
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        ids = ids.astype(str) if ids.dtype == object else ids
        copies = np.diff(lists.offsets.to_numpy())
        first, some = np.cumsum(copies) - copies, np.flatnonzero(copies)
        points = _matrix(part["point"])
        rows = np.flatnonzero(self.asks[:, ring])
        for b in range(0, len(some), self.POINTS):
            at = some[b:b + self.POINTS]
            p = points[at]
            for a in range(0, len(rows), self.ROWS):
                q = rows[a:a + self.ROWS]
                i, j, exact = self._near(q, p)
                n = copies[at[j]]
                other = np.arange(n.sum()) + np.repeat(first[at[j]] - (np.cumsum(n) - n), n)
                self.found.append((np.repeat(q[i], n), np.repeat(exact, n), ids[other]))
                self.more += len(other)
                if self.more > len(self.rep) * self.keep + self.PAIRS:
                    self._best()

    def _near(self, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j) that may be among the best, with their distances."""
        x, size = self.x[q], (p * p).sum(1)
        squares = x @ (-2.0 * p.T)
        squares += size
        squares += self.size[q][:, None]
        slack = 1e-10 * (1.0 + self.size[q] + size.max())  # rounding of the squares
        limit = self.bound[q] ** 2 + slack
        hit = squares <= limit[:, None]
        if len(p) > self.keep and np.count_nonzero(hit) > 4 * self.keep * len(q):
            limit = np.minimum(limit, np.partition(squares, self.keep - 1, axis=1)[:, self.keep - 1] + 2 * slack)
            hit = squares <= limit[:, None]
        i, j = np.nonzero(hit)
        exact = np.empty(len(i))
        for a in range(0, len(i), self.PAIRS):
            at = slice(a, a + self.PAIRS)
            exact[at] = np.sqrt(((p[j[at]] - x[i[at]]) ** 2).sum(1))
        return i, j, exact

    def _best(self) -> None:
        """Leave the best ``keep`` of every query; ties go to the smaller id."""
        i, exact, other = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((other, exact, i))
        i, exact, other = i[order], exact[order], other[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.keep - 1
        self.bound[i[last]] = np.minimum(self.bound[i[last]], exact[last])
        best = rank < self.keep
        self.found, self.more = [(i[best], exact[best], other[best])], 0

    def told(self):
        if not self.found:
            return
        self._best()
        i, exact, other = self.found[0]
        ends = np.searchsorted(i, np.arange(len(self.rep) + 1))
        step = max(1, self.PAIRS // self.keep)
        for a in range(0, len(self.rep), step):
            cut = ends[a:a + step + 1]
            at, offsets = slice(cut[0], cut[-1]), pa.array((cut - cut[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(self.rep[a:a + step]), pa.ListArray.from_arrays(offsets, pa.array(other[at], self.kind)),
                pa.ListArray.from_arrays(offsets, pa.array(exact[at]))], names=["rep", "ids", "distances"])


def knn_join(queries: DataFrame, base: DataFrame | MetricIndex, k: int, id_col: str = "id", vector: str = "vector",
             metric: str = "euclidean", exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
             points_per_cell: int = POINTS_PER_CELL) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` of the ``k`` nearest ``base`` rows per query.

    ``base`` is a fitted index, or a table that is indexed for this search with ``metric``.
    """
    if not isinstance(base, MetricIndex):
        base = MetricIndex.fit(base, id_col, vector, metric, k + (1 if exclude_self else 0), None, block_rows, points_per_cell)
    return base.search(queries, k, id_col, vector, exclude_self)
