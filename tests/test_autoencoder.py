"""The trained autoencoder: gradients, learning, odd rows, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditmill.operators import autoencoder as ae, models as md
from auditmill.session import scratch_path
from tests.test_models import frame


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    sizes = ae.sizes_of(5, (4, 3))
    assert sizes == [5, 4, 3, 4, 5]
    flat, x = ae.seeded(sizes, 7) + 0.05, rng.normal(size=(20, 5))
    grad, error = ae.gradient(x, flat, sizes)
    assert error == pytest.approx(ae.row_errors(x, ae.layers_of(flat, sizes)).sum())
    for i in range(0, len(flat), 7):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (ae.gradient(x, up, sizes)[1] - ae.gradient(x, down, sizes)[1]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-4)


def test_sums_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(2).normal(size=(500, 5))
    sizes = ae.sizes_of(5, (4, 3))
    flats = [ae.seeded(sizes, s) for s in (1, 2)]
    want = [np.append(*ae.gradient(x, f, sizes)) for f in flats]
    for parts in (1, 7):
        got, n = ae.summed_gradients(frame(spark, x).select("vector").repartition(parts), flats, sizes)
        assert n == 500 and np.allclose(got, want)


@pytest.fixture(scope="module")
def curve(spark):
    """Points of a bent sheet in four dimensions, and outliers that leave the sheet but not its linear span."""
    rng = np.random.default_rng(5)
    t = rng.uniform(-1.5, 1.5, size=(1200, 2))
    bent = lambda t: np.stack([t[:, 0], t[:, 1], np.abs(t[:, 0]) * 2 - 1.5, np.abs(t[:, 1]) * 2 - 1.5], axis=1)
    off = bent(rng.uniform(-0.3, 0.3, size=(20, 2)))
    off[:, 2:] += 2.5
    df = frame(spark, np.vstack([bent(t), off]), is_attack=[i >= 1200 for i in range(1220)])
    return df, ae.fit(df.filter("not is_attack"), 4, (24, 12, 3), rates=(0.01, 0.005), epochs=25)


def test_losses_fall_and_outliers_stand_out_more_than_in_the_linear_form(spark, curve):
    df, networks = curve
    assert [len(n.losses) for n in networks] == [25, 25]
    assert networks[0].losses[-1] < 0.3 * networks[0].losses[0]
    def stand_out(scored):
        got = scored.select("is_attack", "score").toPandas()
        return got.score[got.is_attack].median() / got.score[~got.is_attack].median()
    linear = md.reconstruction_error(df, md.autoencoder_fit(df.filter("not is_attack"), 3))
    assert stand_out(ae.score(df, networks[0])) > max(3.0, stand_out(linear))


def test_selection_marks_the_first_best(curve):
    df, networks = curve
    table, scored = ae.selection(df, networks, [90, 95, 99])
    rows = table.collect()
    assert sum(r.best for r in rows) == 1 and {r.rate for r in rows} == {0.01, 0.005}
    assert next(r.f1 for r in rows if r.best) == max(r.f1 for r in rows)
    assert scored.count() == 2 * 1220


def test_saved_network_scores_alike(spark, curve):
    df, networks = curve
    names = ["a", "b", "c", "d"]
    raw = df.select("id", "is_attack", *[F.col("vector")[i].alias(n) for i, n in enumerate(names)])
    scaler = md.scaler(raw.filter("not is_attack"), names)
    scaled = md.scale_rows(raw, scaler, names)
    direct = ae.score(scaled, networks[1])
    path = scratch_path(spark, "saved")
    ae.save(path, scaler, networks[1], md.contamination_threshold(direct.filter("not is_attack"), 0.05))
    saved = {r.id: (r.score, r.pred) for r in ae.score_new_rows(spark, raw, path, names).collect()}
    assert {i: v for i, (v, _) in saved.items()} == {r.id: r.score for r in direct.collect()}
    assert 20 <= sum(p for _, p in saved.values()) < 0.1 * 1220
    back = ae.from_table(ae.to_table(spark, networks))
    assert [n.rate for n in back] == [0.01, 0.005] and all(np.array_equal(a.flat, b.flat) and a.sizes == b.sizes for a, b in zip(back, networks))


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 9.0), (1, [1.0, 2.0], 9.0), (2, None, 9.0), (3, [1.0, None], 9.0), (4, [float("nan"), 1.0], 9.0),
            (5, [1.0], 9.0), (6, [], 9.0), (7, [float("inf"), 1.0], 9.0), (None, [0.0, 0.0], 9.0)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, score double")
    networks = ae.fit(df, 2, (2, 1), rates=(0.01,), epochs=2)
    got = ae.score(df, networks[0]).collect()
    assert len(got) == 9 and len(got[0]) == 3
    assert {r.id for r in got if r.score is not None} == {1, None}
    empty = ae.fit(df.limit(0), 2, (2, 1), rates=(0.01,), epochs=2)
    assert empty[0].losses == [] and np.array_equal(empty[0].flat, ae.seeded(empty[0].sizes, 42))
    assert ae.score(df.limit(0), networks[0]).count() == 0


def test_rows_are_scored_once_for_thresholds_and_results(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in x], i % 9 == 0) for i, x in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, is_attack boolean")
    nets = [ae.Network(r, ae.sizes_of(4), ae.seeded(ae.sizes_of(4), 1)) for r in (0.1, 0.2)]
    _, scored = ae.selection(df, nets, [90])
    assert scored.count() == 120 and "MapInArrow" not in scored._jdf.queryExecution().toString()
