"""Near-duplicates against brute force on all pairs."""

import random

import numpy as np
import pytest

from auditmill.llm import minhash, queries
from tools.check import compare, connect


def brute(rows, width, percent):
    """Links and components by comparing all pairs of real shingle sets."""
    def shingle_set(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        if not w:
            return set()
        width_ = min(width, len(w))
        return {tuple(w[i:i + width_]) for i in range(len(w) - width_ + 1)}

    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "THE", "a b"]
    passage = rng.choices(vocab, k=60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b"), (8, "a\xa0b")]
    bases = [rng.choices(vocab, k=rng.randint(5, 250)) for _ in range(8)]
    while len(rows) < n:
        w = list(rng.choice(bases)) if rng.random() < 0.7 else rng.choices(vocab, k=rng.randint(1, 120)) + passage
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((len(rows) + 1, rng.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(1, 260)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {tuple(r)[:4] for r in got} == brute(rows, 4, 80) and len(got) == len(rows)


def test_open_buckets_find_links_that_no_bucket_head_shows(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:90 - 7 * i] + [f"x{i}_{k}" for k in range(4 + i)] + base[90 - 7 * i:])) for i in range(6)]
    rows += [(100 + i, " ".join([f"y{i}_{k}" for k in range(60)] + base[:60])) for i in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {tuple(r)[:4] for r in got} == brute(rows, 4, 80)


def test_sketch_is_filled_and_concentrated():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))])
    s = minhash.sketches([a, b, a[:1], a[:1], np.zeros(0, np.uint64)])
    true = 900 / (len(a) + len(b) - 900)
    assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert (s[2] == s[3]).all() and len(set(s[2].tolist())) > 100
    many = [np.unique(rng.integers(0, 2**63, 3).astype(np.uint64)) for _ in range(300)]
    half = minhash.sketches([np.append(m[:2], np.uint64(k)) for k, m in enumerate(many)] + many)
    assert abs((half[:300] == half[300:]).mean() - 0.5) < 0.03


def test_odd_rows(spark):
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 1), (None, "a b c d e", 2), (None, "q r s t u", 3), (9, "q r s t u v", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(df, width=4).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 2, None, False), (9, 3, 9, True), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    rows = [(1, base), (None, " ".join([*words[:58], "x"])), (None, " ".join(["y", *words[2:]])), (None, base)]
    other = [f"v{i}" for i in range(60)]
    rows += [(None, " ".join(other)), (None, " ".join([*other[:58], "z"])), (None, " ".join([*other[:58], "z"])), (3, "something else is said here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, width=3, percent=80).collect()
    assert sorted(str(r.component_id) for r in got) == sorted(["1"] * 4 + ["None"] * 3 + ["3"])
    unnamed = [r for r in got if r.component_id is None]
    assert 1 <= sum(r.leads for r in unnamed) <= 2 and len({r.row_id for r in unnamed if r.leads}) == 1


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op7_minhash"](spark, sf), connect(sf), queries.ORACLES["op7_minhash"]) is None


def test_only_texts_that_are_asked_for_move(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(2_000)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    ids = spark.createDataFrame([(7,), (7,), (1_999,), (5_000,)], "id long")
    got = sorted(tuple(r) for r in minhash.among(texts, ids).collect())
    assert {(7, "text 7"), (7, "again"), (1_999, "text 1999")} <= set(got) and len(got) <= 10
    assert minhash.among(texts, ids.filter("id < 0")).count() == 0
