"""Shards: exact balance, gapless slots, few cut links."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from auditmill.llm import common, sharding


def check(rows, got, shards):
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("cell", [50_000, 40])
def test_balanced_and_together(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL", cell)
    rng = random.Random(1)
    texts = ["hot"] * 500 + [f"pair {i}" for i in range(150) for _ in "ab"] + [f"ten {i}" for i in range(20) for _ in range(10)] + [f"own {i} é" for i in range(500)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    check(rows, got, 6)
    where, text = defaultdict(Counter), dict(rows)
    for r in got:
        where[text[r.doc_id]][r.shard] += 1
    kept = sum(n * (n - 1) for t, c in where.items() if t != "hot" for n in c.values())
    all_pairs = sum(sum(c.values()) * (sum(c.values()) - 1) for t, c in where.items() if t != "hot")
    assert kept / all_pairs > 0.9
    assert max(where["hot"].values()) > 200  # of 500, in shards of 250


def test_everything_linked(spark):
    rows = [(i, f"t{i % 30}") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    check(rows, got, 7)


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "a"), (5, "a"), (None, "a"), (6, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, shard int, grp string")
    check(rows, sharding.shard(df, shards=24).collect(), 24)
    assert sharding.shard(df.limit(0)).count() == 0


def test_ranks_over_cells(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as k", "id % 7 as v")
    got = common.dense_rank_in(df, ["k"], [df.id], df.id % 11, "r", {"s": df.v}).collect()
    for k in range(3):
        mine = sorted((r for r in got if r.k == k), key=lambda r: (r.id % 11, r.id))
        total = 0
        for i, r in enumerate(mine):
            assert (r.r, r.s) == (i, total)
            total += r.v
