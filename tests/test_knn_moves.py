"""What a neighbour search moves and holds where nothing can be pruned."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditmill.operators import knn
from auditmill.operators.knn import Bounds, Chunk, MetricIndex


def test_points_move_once_for_a_chunk_of_queries_whatever_the_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_TOGETHER", 50)
    monkeypatch.setattr(knn, "CHUNKS", 6)
    rng = np.random.default_rng(5)
    moved = {}
    for n in (300, 1_200):
        x = rng.normal(size=(n, 24))  # all distances are much alike
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
        index = MetricIndex.fit(df, most=5, path=f"{tmp_path}/{n}", block_rows=20, points_per_cell=20)
        wanted, chunks = index._dealt(df.select(F.col("vector").alias("vec")), 5)
        asked = index.asked(wanted.withColumn("limit", F.lit(float("inf"))), 5)
        rings = spark.createDataFrame(list(zip(index.bounds.cell.tolist(), index.bounds.ring.tolist(), index.bounds.n.tolist())), "cell long, ring long, n long")
        moved[n] = n + asked.join(rings, ["cell", "ring"]).agg(F.sum("n")).first()[0]  # queries, and points for each chunk
        assert chunks == 6 and moved[n] <= (6 + 1) * n
        got = {}
        for r in index.search(df, 4, exclude_self=True).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.neighbor_id)
        for i in range(0, n, 17):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            assert got[i] == [j for j in np.argsort(d, kind="stable") if j != i][:4]
    assert moved[1_200] <= 4 * moved[300]  # in proportion to the points


def test_a_chunk_holds_a_bounded_number_of_neighbours(monkeypatch):
    monkeypatch.setattr(Chunk, "PAIRS", 64)
    monkeypatch.setattr(Chunk, "POINTS", 32)
    rng = np.random.default_rng(6)
    q, x, keep = rng.normal(size=(40, 6)), rng.normal(size=(4_000, 6)), 9
    bounds = Bounds(np.zeros((1, 6)), np.array([[0, 0, len(x), 1, 0, np.inf]]), "euclidean")
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    chunk = Chunk([pa.RecordBatch.from_arrays([pa.array(range(40)), lists(q), pa.array([np.inf] * 40)], names=["rep", "point", "limit"])], bounds, keep)
    for a in range(0, len(x), 500):  # the farthest come first, so every batch has nearer ones
        part = np.argsort(-(x * x).sum(1))[a:a + 500]
        chunk.meet(0, pa.RecordBatch.from_arrays([lists(x[part]), pa.array([[int(j)] for j in part])], names=["point", "ids"]))
        assert chunk.more <= 40 * keep + 64
    told = pa.Table.from_batches(chunk.told())
    assert told["rep"].to_pylist() == list(range(40))
    for i, ids in enumerate(told["ids"].to_pylist()):
        assert ids == np.argsort(((x - q[i]) ** 2).sum(1), kind="stable")[:keep].tolist()


def test_chunks_are_held_together_where_that_moves_fewer_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_TOGETHER", 50)
    monkeypatch.setattr(knn, "CHUNKS", 12)
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(900, 24)), rng.normal(size=(700, 24))
    x[300:600] = x[:300]  # copies are told apart by their ids
    df = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, vector array<double>")
    index = MetricIndex.fit(df, most=5, path=f"{tmp_path}/index", block_rows=50, points_per_cell=50)
    wanted, chunks = index._dealt(asked.select(F.col("vector").alias("vec")), 5)
    rows, groups, parts = index._moved(wanted.withColumn("limit", F.lit(float("inf"))), chunks, 5)
    assert chunks == 12 and groups < chunks and groups * parts >= chunks
    assert rows.count() <= 600 * groups + 700 * parts <= 0.6 * (600 * chunks + 700)
    got = {}
    for r in index.search(asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    for i in range(0, 700, 7):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        assert got[i] == [f"p{j}" for j in sorted(range(900), key=lambda j: (round(d[j], 12), f"p{j}"))[:5]]


def test_a_group_of_chunks_stays_within_what_a_task_may_hold():
    for points, queries, chunks in ((1_000_000, 500_000, 24), (100, 500_000, 24), (5_000_000, 3_000_000, 46), (10_000, 40, 1)):
        together, parts = knn.grid(points, points * chunks, queries, chunks, 65_536)
        groups = -(-chunks // together)
        assert together == 1 or together * -(-queries // chunks) <= 65_536
        assert groups * parts >= min(chunks, knn.CHUNKS) and points * groups + queries * parts <= points * chunks + queries
    assert knn.grid(1_000_000, 1_000_000, 500_000, 24, 65_536) == (1, 1)  # chunks that ask for different points


def test_a_wave_of_few_chunks_still_makes_as_many_tasks():
    for chunks in (1, 3, 24):
        together, parts = knn.grid(1_000_000, 1_000_000 * chunks, 44_000 * chunks, chunks, 50_000, 24)
        assert -(-chunks // together) * parts >= 24
