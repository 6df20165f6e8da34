"""Exact top-k against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from auditmill.llm import queries, topk
from tools.check import compare, connect


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v):
            ok.setdefault(i, []).append([math.floor(256 * Fraction(c)) for c in v])
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        x = min(ok[q])
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, many in ok.items() if i != q for y in many if len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("QUERIES_TOGETHER", 3), ("CANDIDATES_TOGETHER", 20), ("SEED_CANDIDATES", 5), ("PAIRS", 7)):
            monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30], p=[0.5, 0.4, 0.1]) * np.linspace(3, 0.1, 8)).round(2).tolist()) for i in range(120)]
    rows += [(200, None), (201, [float("nan")] * 8), (202, [1.0] * 7 + [None]), (203, [0.0] * 8), (204, []), (205, [1.0, 2.0]), (206, [3.0, 1.0]), (None, [1.0] * 8),
             (207, rows[3][1]), (208, rows[3][1]), (210, rows[3][1]), (210, rows[5][1]), (215, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, "vec_id % 5 = 0").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 5)


def test_outliers_take_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "WIDE_TOGETHER", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(40)]
    # large components, also against each other and with results that fit only by cancelling
    rows += [(50, [1e7, 1e7, 0.0, 0.0]), (51, [4e6, -4e6, 0.0, 0.5]), (55, [1e7, -1e7, 1.0, 1.0]), (56, [0.0, 0.0, 3e7, 0.0]), (57, [9e6, 1e6, 1e6, 1e6]), (58, [1e7, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, "vec_id % 5 = 0", k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 4, 5)
    # a product of 625 digits ranks last as long as it is negative
    far = spark.createDataFrame([*rows[:20], (60, [0.0, 0.0, 0.0, 1.0]), (61, [0.0, 0.0, 0.0, -1e308])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(far, "vec_id = 60", k=4).collect()] == [r[2] for r in brute([*rows[:20], (60, [0.0, 0.0, 0.0, 1.0])], 4, 60) if r[0] == 60]
    with pytest.raises(Exception, match="63 bits"):
        topk.top_k(far, "vec_id = 61", k=30).collect()


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, "vec_id = 0").collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), "vec_id = 0").count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op4_topk_search"](spark, sf), connect(sf), queries.ORACLES["op4_topk_search"]) is None
