"""Ranked search against brute force, and the bounds themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from auditmill.llm import lexical, queries
from tools.check import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in want if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("DOCS_TOGETHER", 20), ("ITEMS_TOGETHER", 3), ("TERMS_SENT", 0), ("FIRST_READ", 1)):
            monkeypatch.setattr(lexical, name, n)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "日本", "the", "x1y"]
    say = lambda n: " ".join(rng.choice(vocabulary[:1 + int(rng.random() ** 3 * len(vocabulary))]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 40))) for i in range(150)]
    docs += [(200 + i, "The the THE, w1.w2") for i in range(80)]  # ties, and a frequent term
    docs += [(None, "w5 w6"), (None, None), (300, ""), (301, "?!"), (302, say(20_000)), (7, docs[7][1]), (7, "w9 w8")]
    items = [(i, say(rng.randint(1, 12))) for i in range(10)] + [(20, None), (21, "?"), (22, "unheard"), (None, "w3 w4"), (3, "W17 the"), (4, docs[9][1])]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, key int, n int").repartition(4)
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, q int")
    got = sorted((tuple(r) for r in lexical.search(d, b, k=10).collect()), key=repr)
    assert got == brute(docs, items, 10)


def test_bounds_give_exact_scores():
    rng = np.random.default_rng(1)
    n = 4000
    lists, scores = [], np.zeros(n, np.int64)
    for i in range(6):
        docs = rng.choice(n, 3000, replace=False)
        impact = np.sort((rng.pareto(1.2, 3000) * 1000).astype(np.int64) + 1)[::-1]
        scores[docs] += impact
        lists.append((docs, impact))
    order = rng.permutation(n)
    found, score = lexical.nra(lists, n, order, 10)
    want = np.lexsort((order, -scores))[:10]
    assert found.tolist() == want.tolist() and score.tolist() == scores[want].tolist()
    # once membership was settled, what cannot get there was no longer followed
    assert sum(len(d) for d, _ in lists) < 18_000


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(d.limit(0), b).count() == 0
    assert lexical.search(d, b.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(d, b).collect()] == [(1, 1, 1)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op13_lexical_search"](spark, sf), connect(sf), queries.ORACLES["op13_lexical_search"]) is None
