"""Importance resampling: separation of planted documents, the sampling itself, odd rows."""

import random

import numpy as np
import pytest

from auditmill.llm import quality


def corpus(n, seed=5):
    rng = random.Random(seed)
    syllables = "the an er on re ti in ea sh nt".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, truth = [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        truth[i] = rng.choices(["good", "foul", "noise"], [0.8, 0.1, 0.1])[0]
        if truth[i] == "foul":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zonkvile", "grubmuck", "Fwapscum"])
        elif truth[i] == "noise":
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
    return docs, truth


def test_planted_documents_go_and_clean_ones_stay(spark):
    docs, truth = corpus(2500)
    labels = [(i, int(truth[i] != "noise"), int(truth[i] == "foul")) for i in range(0, 2500, 2)]
    got = quality.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r.doc_id for r in got if r.selected}
    good = [i for i, t in truth.items() if t == "good"]
    bad = [i for i, t in truth.items() if t != "good"]
    assert len(got) == len(docs)
    assert np.mean([i in kept for i in good]) > 0.98 and np.mean([i in kept for i in bad]) < 0.05


def test_keys_are_gumbel_and_the_largest_are_kept(spark):
    docs, truth = corpus(400)
    labels = spark.createDataFrame([(i, 1, int(truth[i] == "foul")) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.resample(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    noise = np.array([r.key - r.weight for r in got])
    assert abs(noise.mean() - 0.5772) < 0.2 and abs(noise.std() - 1.2825) < 0.2
    kept, lost = [r.key for r in got if r.selected], [r.key for r in got if not r.selected]
    assert not lost or min(kept) >= max(lost)


def test_weight_is_that_of_the_worst_passage():
    rng = np.random.default_rng(0)
    ratio = rng.normal(size=quality.EDGES[-1])
    texts = [b"", b"a", b"short text", b"x" * 31, b"y z " * 200, "é ü".encode() * 40]
    t = quality.Text(texts)
    for text, w in zip(texts, t.weights(ratio)):
        one = quality.Text([text])
        each = ratio[one.grams].copy()
        each[one.start] += ratio[quality.GRAMS + one.pairs] + sum(ratio[quality.EDGES[2] + b] for b in one.begins)
        want = min(each[i:i + quality.PASSAGE].sum() for i in range(len(each))) if text else 0
        assert abs(w - want) < 1e-3
    assert (quality.Text([b"ab cd"]).grams == quality.Text([b"zz zz", b"ab cd"]).grams[5:]).all()


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "fine words here", "c"), (3, "fine words here", "c"), (None, "no id", "d"), (4, "x" * 3_000_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(rows) and [r.weight for r in got if r.doc_id in (1, 2)] == [0, 0]
    none = quality.resample(docs, labels.limit(0)).collect()
    assert all(r.selected for r in none if r.doc_id is not None) and len(none) == len(rows)
    assert quality.resample(docs.limit(0), labels).count() == 0
