"""Weights, quotas and passes of mixed sources."""

import math
from collections import Counter, defaultdict

import pytest

from auditmill.llm import mixing


def test_exponent_meets_its_target():
    shares = [0.7, 0.2, 0.06, 0.04]
    for limit in (1.0, 1.5, 4.0):
        x = mixing.exponent_for(shares, max_repetition=limit)
        assert math.isclose(mixing.repetition(shares, mixing.tempered(shares, x)), limit, rel_tol=1e-9)
    assert mixing.exponent_for(shares, max_repetition=100) == 0.0 and mixing.exponent_for(shares) == 0.0
    x = mixing.exponent_for(shares, target_entropy=1.2)
    assert math.isclose(mixing.entropy(mixing.tempered(shares, x)), 1.2, rel_tol=1e-9)
    assert mixing.exponent_for(shares, target_entropy=9.0) == 0.0 and mixing.exponent_for(shares, target_entropy=0.1) == 1.0


@pytest.mark.parametrize("block", [10_000, 7])
def test_every_pass_is_whole_or_uses_its_quota(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = [(i, "w " * (1 + i % 5), "big" if i < 400 else "mid" if i < 500 else "small" if i < 530 else None) for i in range(545)]
    rows += [(600, None, "small"), (601, "", "empty"), (602, "x y", "small"), (602, "x y", "small")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, weight int")
    got = mixing.mix(df, max_repetition=2.5).collect()
    n, count = Counter(), Counter()
    for i, t, s in rows:
        n[s] += len((t or "").split())
        count[s] += 1
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    weight = {r.source: r.weight for r in got}
    assert math.isclose(sum(weight.values()), 1, rel_tol=1e-9)
    used, passes = Counter(), defaultdict(list)
    for r in got:
        used[r.source] += r.n_tokens
        passes[r.source, r.epoch].append(r)
    budget = math.ceil(n["big"] / weight["big"])
    for s, w in weight.items():
        assert w * budget - 5 <= used[s] <= w * budget + 1 or n[s] == 0
    for (s, e), rs in passes.items():
        assert len({r.position for r in rs}) == len(rs) and max(r.position for r in rs) < count[s]
        if (s, e + 1) in passes:
            assert len(rs) == count[s]
    assert [r.doc_id for r in sorted(passes["small", 0], key=lambda r: r.position)][:20] != [r.doc_id for r in sorted(passes["small", 1], key=lambda r: r.position)][:20]
    assert max(used[s] / n[s] for s in n if n[s]) < 2.6


@pytest.mark.parametrize("block", [10_000, 3])
def test_long_documents_leave_no_gap(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    long_text = "w " * 300
    rows = [(i, "v " * (20 + i % 7), "big") for i in range(300)]
    rows += [(None if i % 3 == 0 else 1000 + i // 2, "u " * (10 + i % 11), "small") for i in range(60)] + [(2000, long_text, "small"), (2001, long_text, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget, seed in ((None, 0), (4_000, 1)):
        got = mixing.mix(df, max_repetition=1.7, budget=budget, seed=seed).collect()
        total = budget or max(math.ceil(sum(r.n_tokens for r in got if r.source == s and r.epoch == 0) / w) for s, w in {(r.source, r.weight) for r in got} if s == "big")
        for source, weight in {(r.source, r.weight) for r in got}:
            mine = [r for r in got if r.source == source]
            last = Counter((r.doc_id, r.text) for r in mine if r.epoch == max(r.epoch for r in mine))
            unused = Counter((r[0], r[1]) for r in rows if r[2] == source) - last
            quota = weight * total
            assert sum(r.n_tokens for r in mine) <= quota + 1
            if unused:
                assert quota - sum(r.n_tokens for r in mine) < 1 + min(len(t.split()) for _, t in unused)


def test_budget_and_empty(spark):
    df = spark.createDataFrame([(i, "a b", "s" if i < 8 else "t") for i in range(10)], "doc_id long, text string, source string")
    got = mixing.mix(df, max_repetition=1.0, budget=10).collect()
    assert sum(r.n_tokens for r in got) <= 10 and len(got) == 5
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.withColumn("text", df.text.substr(1, 0))).count() == 10
