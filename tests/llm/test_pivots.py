"""Near-duplicate vectors against brute force: links found are links, and at least nine in ten are found."""

import numpy as np
import pytest

from auditmill.llm import pivots, queries
from tools.check import compare, connect


def brute(ids, x, cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= cosine) & ~np.eye(len(u), dtype=bool)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(link, root[None, :], root.max() + 1).min(axis=1))
        if (new == root).all():
            return link.sum(axis=1), root
        root = new


def groups(seed, spread, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [centres[g] / np.linalg.norm(centres[g]) + rng.normal(size=dim) * spread / np.sqrt(dim) for g in rng.choice(12, 500, p=[0.4] + [0.6 / 11] * 11)]
    return np.array(rows + [rng.normal(size=dim) for _ in range(200)])


@pytest.mark.parametrize("block", [512, 16])
def test_tight_groups_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    x = groups(1, 0.05)
    got = pivots.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), pivots=64).collect()
    n, root = brute(range(len(x)), x, 0.95)
    assert sorted(tuple(r) for r in got) == [(i, int(n[i]), int(root[i]), bool(root[i] == i)) for i in range(len(x))]


def test_recall_of_loose_groups(spark):
    x = groups(2, 0.25)
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), pivots=64).collect()}
    n, _ = brute(range(len(x)), x, 0.95)
    assert all(got[i].n_links <= n[i] for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.9 * n.sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e-200, 0.0]), (4, [1e300, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []),
            (11, [1.0]), (12, [0.0, 1.0]), (12, [0.0, 1.0]), (None, [1.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((tuple(r) for r in pivots.near_duplicates(df).collect()), key=str)
    none = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 13)]
    assert got == sorted([(i, 3, 1, i == 1) for i in (1, 2, 3, 4)] + none + [(12, 1, 12, True)] * 2 + [(None, 0, None, False)], key=str)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op10_pivot_index"](spark, sf), connect(sf), queries.ORACLES["op10_pivot_index"]) is None
