"""Distributed ranks, neighbours, outlier factor, forest and metrics against brute force."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditmill.functions.ranks import auc, exact_percentiles
from auditmill.operators import knn, models as md, scoring as sc
from auditmill.operators.knn import MetricIndex, knn_join
from auditmill.session import own_dir
from tools.check import compare


def frame(spark, x, **cols):
    rows = [(i, [float(v) for v in r], *[c[i] for c in cols.values()]) for i, r in enumerate(x)]
    kinds = {"is_attack": "boolean", "attack_id": "int"}
    return spark.createDataFrame(rows, ", ".join(["id long, vector array<double>", *[f"{c} {kinds.get(c, 'double')}" for c in cols]]))


def brute(q, b, k, exclude_self, metric):
    out = {}
    for i in range(len(q)):
        if metric == "cosine":
            nq, nb = np.linalg.norm(q[i]), np.linalg.norm(b, axis=1)
            d = 1 - np.divide(b @ q[i], nq * nb, out=np.zeros(len(b)), where=nq * nb > 0)
        else:
            d = np.sqrt(((b - q[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(b)), np.round(d, 12))) if not (exclude_self and j == i)]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_with_crowds_of_copies(spark, metric, exclude_self):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) + rng.integers(0, 4, size=(300, 1)) * 8
    x[100:200] = x[0]     # a third of the points are equal
    x[250] = 0.0          # a zero vector
    df = frame(spark, x)
    near = knn_join(df, df, 7, metric=metric, exclude_self=exclude_self, block_rows=16, points_per_cell=20)
    got = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, round(r.distance, 9)))
    want = brute(x, x, 7, exclude_self, metric)
    assert set(got) == set(want)
    for i in want:
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-6)
        if metric == "euclidean":
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_knn_with_fewer_points_than_k(spark):
    df = frame(spark, [[0.0], [1.0], [3.0]])
    near = knn_join(df, df, 5, exclude_self=True).groupBy("query_id").count().collect()
    assert {r["count"] for r in near} == {2}


def test_stored_index_is_fitted_once_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(3)
    moved = {}
    for n in (500, 2_000):
        x = rng.normal(size=(n, 3)) * 0.05 + rng.integers(0, 12, size=(n, 3)) * 5
        df, path = frame(spark, x), f"{tmp_path}/{n}"
        MetricIndex.fit(df, most=6, path=path, block_rows=25, points_per_cell=25)
        index = MetricIndex.load(spark, path)
        # two searches read the same files
        for queries, exclude in ((df, True), (df.filter("id % 7 = 0"), False)):
            got = {}
            for r in index.search(queries, 4, exclude_self=exclude).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.neighbor_id)
            for i in list(got)[::41]:
                d = np.sqrt(((x - x[i]) ** 2).sum(1))
                order = [j for j in np.lexsort((np.arange(n), d)) if not (exclude and j == i)]
                assert got[i] == order[:4]
        every = df.select(F.col("vector").alias("vec"), F.col("id").alias("rep"), F.lit(0.5).alias("limit"))
        asked = index.asked(every.withColumn("limit", F.lit(float("nan"))), 5).unionByName(index.asked(every, 5))
        moved[n] = asked.agg(F.sum("times")).first()[0]  # vectors that go to a ring
        assert moved[n] < 0.15 * n * len(index.bounds.ring)
    assert moved[2_000] < 7 * moved[500]  # four times the points: in proportion, not with the square


def test_index_leaves_out_what_is_no_point(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert sorted((r.query_id, r.neighbor_id) for r in knn_join(df, df, 3, exclude_self=True).collect()) == [(0, 1), (1, 0)]
    assert knn_join(df, df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="copies"):
        MetricIndex.fit(df, most=2).search(df, 3)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=700), np.full(300, 0.25), rng.integers(0, 5, 200)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, g int")
    shares = [0.0, 0.01, 0.5, 0.9, 0.95, 0.999, 1.0]
    assert exact_percentiles(df, "v", shares).first()[0] == pytest.approx(list(np.percentile(values, [s * 100 for s in shares])))
    for r in exact_percentiles(df, "v", shares, by="g").collect():
        assert r.percentiles == pytest.approx(list(np.percentile(values[r.g::2], [s * 100 for s in shares])))


def test_auc_with_ties_and_one_class(spark):
    s = [1, 1, 2, 2, 3, 3, 3, 4]
    y = [False, True, False, True, False, True, True, True]
    df = spark.createDataFrame(list(zip(map(float, s), y)), "s double, y boolean")
    pos = [a for a, b in zip(s, y) if b]
    neg = [a for a, b in zip(s, y) if not b]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc(df, "s", F.col("y")).first()[0] == pytest.approx(want)
    assert auc(df.filter("y"), "s", F.col("y")).first()[0] is None


def test_threshold_takes_the_first_best(spark):
    df = spark.createDataFrame([(float(i), i >= 95) for i in range(100)], "score double, is_attack boolean")
    best = sc.best_f1_threshold(df, [90, 94, 95, 96]).first()
    assert best.percentile == 95 and best.f1 == pytest.approx(1.0)
    flat = spark.createDataFrame([(1.0, i == 0) for i in range(10)], "score double, is_attack boolean")
    assert sc.best_f1_threshold(flat, [80, 90]).first().percentile == 80


def test_minmax_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    assert [(r.an, r.bn) for r in sc.minmax(df, {"a": "an", "b": "bn"}).orderBy("b").collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_lof_is_one_on_a_grid_and_high_outside(spark):
    grid = np.array([[i, j] for i in range(12) for j in range(12)], dtype=float)
    x = np.vstack([grid, [[40.0, 40.0]]])
    out = {r.id: r.score for r in md.lof_score(frame(spark, grid), frame(spark, x), 8).collect()}
    assert len(out) == 145
    assert out[12 * 6 + 6] == pytest.approx(1.0, abs=0.05)
    assert max(out, key=out.get) == 144 and out[144] > 3


def test_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(1000, 6)), rng.normal(size=(8, 6)) + 9])
    test = frame(spark, x, is_attack=[i >= 1000 for i in range(1008)])
    forest = md.isolation_forest_fit(test.filter("id < 1000"), ["id"], 60)
    sizes = forest.filter("node = 0").select("tree", "size").collect()
    assert len(sizes) == 60 and all(r["size"] == 256 for r in sizes)
    scored = md.isolation_forest_score(test, forest)
    top = [r.id for r in scored.orderBy(F.desc("score")).limit(8).collect()]
    assert set(top) == set(range(1000, 1008))
    assert scored.filter("score <= 0 or score >= 1").count() == 0
    assert auc(scored, "score", F.col("is_attack")).first()[0] > 0.99
    again = md.isolation_forest_score(test.repartition(7), md.isolation_forest_fit(test.filter("id < 1000").repartition(3), ["id"], 60))
    a = {r.id: r.score for r in scored.collect()}
    assert {r.id: pytest.approx(r.score) for r in again.collect()} == a


def test_path_constant():
    assert list(md.path_constant([1, 2])) == [0.0, 1.0] and md.path_constant([256])[0] == pytest.approx(10.2448, abs=1e-3)


def test_reconstruction_error_finds_rows_off_the_subspace(spark):
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(2, 6))
    x = rng.normal(size=(300, 2)) @ basis
    x = np.vstack([x, rng.normal(size=(1, 6)) * 5])
    df = frame(spark, x)
    out = {r.id: r.score for r in md.reconstruction_error(df, md.autoencoder_fit(df.filter("id < 300"), 2)).collect()}
    assert max(out, key=out.get) == 300 and max(v for i, v in out.items() if i < 300) < 1e-9


def test_metrics_on_zero_denominators(spark):
    df = spark.createDataFrame([(0, False, 0, "normal")] * 3, "pred int, is_attack boolean, attack_id int, attack_name string")
    m = sc.binary_metrics(df, F.col("pred") == 1, F.col("is_attack")).first()
    assert (m.precision, m.recall, m.f1, m.false_positive_rate, m.true_negatives) == (0.0, 0.0, 0.0, 0.0, 3)
    assert sc.per_attack_detection(df, "pred").count() == 0


def test_scored_pipeline_fuses_the_three_models(spark):
    import os

    import pytest

    import __spark_entry__ as entry
    from auditmill import vocab
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    grid = entry.queries()["forest_selection"](spark, sf).collect()
    assert len(grid) == len(vocab.TREE_GRID) * len(vocab.CONTAMINATION_GRID) and sum(r.best for r in grid) == 1
    assert max(r.f1 for r in grid) == next(r.f1 for r in grid if r.best)
    rows = entry.queries()["scored_pipeline"](spark, sf).collect()
    assert len(rows) == entry.queries()["feature_matrix"](spark, sf).count()
    for r in rows:
        total = sum(w * r[f"{m}_norm"] for m, w in vocab.ENSEMBLE_WEIGHTS.items())
        assert abs(total - r.ensemble_score) < 1e-5
        assert r.vote_count == r.if_pred + r.lof_pred + r.ae_pred and r.majority_vote == int(r.vote_count >= 2)


def brute_lof(train, test, k):
    """Novelty LOF by all pairs; ties go to the row that comes first."""
    def near(x, own):
        d = np.sqrt(((x[:, None] - train[None]) ** 2).sum(2))
        if own:
            d[np.arange(len(train)), np.arange(len(train))] = np.inf
        at = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, axis=1)

    (i, d), (j, e) = near(train, True), near(test, False)
    reach = d[:, -1]
    density = [1 / (np.maximum(dist, reach[at]).mean(1) + 1e-10) for at, dist in ((i, d), (j, e))]
    return density[0][j].mean(1) / density[1]


@pytest.mark.parametrize("together", [10, 1 << 22])
def test_lof_of_copies_in_blocks_and_waves(spark, monkeypatch, together):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(260, 3)) * 2)  # many ties and copies
    x[40:70] = x[3]                              # more copies than k
    test = np.vstack([x, rng.normal(size=(40, 3)) * 4])
    monkeypatch.setattr(md, "NUMBERS_TOGETHER", 3 * together)
    monkeypatch.setattr(knn, "MOVED_TOGETHER", 50 * together)
    monkeypatch.setattr(knn, "LEAST_TOGETHER", 20)
    waves = []
    made = MetricIndex._waves
    monkeypatch.setattr(MetricIndex, "_waves", lambda *a: waves.append(made(*a)) or waves[-1])
    monkeypatch.setattr(MetricIndex.fit.__func__, "__defaults__", (*MetricIndex.fit.__func__.__defaults__[:-2], 20, 20))
    got = {}
    for r in md.lof_k_grid(frame(spark, x), frame(spark, test), [4, 7, 9]).collect():
        got[r.k, r.id] = r.score
    assert len(got) == 3 * 300 and (len(waves[-1]) > 1) == (together == 10)
    for k in (4, 7, 9):
        assert [got[k, i] for i in range(300)] == pytest.approx(brute_lof(x, test, k).tolist(), rel=1e-9)


def test_lof_where_ids_repeat_is_that_of_their_rows_together(spark):
    x = np.array([[i * 1.5, j] for i in range(9) for j in range(9)], dtype=float)
    df, twice = frame(spark, x), frame(spark, np.vstack([x, x]))
    ids = F.col("id") % 81
    got = {r.id: r.score for r in md.lof_score(twice.withColumn("id", ids), df, 6).collect()}
    assert len(got) == 81 and all(v > 0 for v in got.values())


def test_lof_k_grid_takes_the_whole_list_of_k(spark):
    rng = np.random.default_rng(4)
    train = frame(spark, rng.normal(size=(26, 2)))
    found = {r.k: r["count"] for r in md.lof_k_grid(train, train).groupBy("k").count().collect()}
    assert found == {k: 26 for k in (5, 10, 15, 20)}  # 5 and 15 are the root and ten more; 30 and 50 are too many
    assert md.lof_k_grid(train.limit(1), train).count() == 0


def test_the_registered_lof_k_grid_has_every_candidate(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), i % 8) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = entry.queries()["lof_k_grid"](spark, str(tmp_path))
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {k: 80 for k in md.lof_candidates(70)}
    assert compare(out, connect_one(tmp_path), entry.oracle_sql()["lof_k_grid"]) is None


def connect_one(path):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    return con


def test_a_step_leaves_neither_shuffle_files_nor_tables(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(size=(400, 3)))
    md.lof_score(df, df, 5).count()  # compiled, and the session's folders are made
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.startswith("shuffle_") for d in blocks.localDirsString() for _, _, files in os.walk(d) for f in files)
    tables = lambda: set(os.listdir(own_dir(spark).removeprefix("file:")))
    files, before = held(), tables()
    scores = md.lof_score(df, df, 5)
    left = sorted(t.rsplit("-", 1)[0] for t in tables() - before)
    assert left == ["factors"] and scores.count() == 400
    until = time.time() + 20
    while held() > files + 40 and time.time() < until:
        time.sleep(0.5)
    assert held() <= files + 40


def test_a_tree_grows_where_a_cut_is_rounded_up(spark):
    one = float(np.nextafter(1.0, 2.0))  # no number lies between the two values
    df = frame(spark, [[1.0], [one]] * 100)
    trees = md.isolation_forest_fit(df, ["id"], 20).filter("left >= 0").count()
    assert trees == 20


def test_cuts_below_a_value_are_found_by_halving(spark):
    from auditmill.functions.ranks import cuts_below
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 100, 255):
        cuts = sorted(float(v) for v in rng.integers(0, 60, n))
        values = [float(v) / 2 for v in range(-4, 130)] + [float("nan")]
        df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("cuts", F.lit(cuts).cast("array<double>") if n else F.array().cast("array<double>"))
        column = cuts_below(F.col("cuts"), F.col("v"), 256)
        assert "filter(" not in str(column)  # 8 steps for a row, not one for each cut
        for r in df.select("v", column.alias("n")).collect():
            assert r.n == (n if np.isnan(r.v) else sum(c < r.v for c in cuts))


def test_the_scaler_of_many_columns_is_one_row(spark):
    rng = np.random.default_rng(9)
    names = [f"c{i}" for i in range(19)]
    x = rng.normal(size=(50, 19))
    x[:, 3] = 7.0
    row = md.scaler(spark.createDataFrame([[float(v) for v in r] for r in x], names), names).collect()
    assert len(row) == 1 and list(row[0].mean) == pytest.approx(x.mean(0).tolist())
    assert list(row[0]["std"]) == pytest.approx(np.where(np.arange(19) == 3, 1.0, x.std(0)).tolist())
