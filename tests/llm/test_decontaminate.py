"""Benchmark windows in documents against brute force."""

import hashlib
import random
import re

import pytest

from auditmill.llm import decontaminate, queries
from tools.check import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10, width=5, percent=100):
    out = []
    cut = []
    for item, text in items:
        w = words(text)
        cut += [(item, w[i:i + window]) for i in range(max(len(w) - window, 0) + 1) if w]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in cut:
            k = min(width, len(x))
            places = range(len(x) - k + 1)
            for i in range(len(w) - len(x) + 1):
                same = sum(w[i + o:i + o + k] == x[o:o + k] for o in places)
                if same >= 1 and 100 * same >= percent * len(places):
                    hit |= set(range(i, i + len(x)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(1)
    vocabulary = ["eins", "zwei", "drei", "Vier", "fünf", "ÄÖ", "日本", "a1", "b", "c"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(8, 24))) for i in range(12)]
    items += [(20, "eins zwei"), (21, "qq"), (22, ""), (23, None), (24, "... !"), (None, say(12)), (25, items[0][1]), (0, say(15)), (2, items[2][1])]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 90):
        _, text = items[rng.randrange(20)]
        text = text or ""
        docs.append((i, f"{say(rng.randint(0, 9))}. {text.upper() if i % 7 == 0 else text}, {say(rng.randint(0, 9))} {text if i % 5 == 0 else ''}"))
    passage = items[3][1]
    docs += [(100 + i, f"{say(i % 4)} {passage}") for i in range(60)]  # a third of all rows share a passage
    docs += [(None, None), (None, passage), (200, ""), (201, "-- ??"), (100, docs[90][1]), (202, (say(30) + " " + passage + " ") * 300), (203, "QQ qq Qq"), (204, "eins.zwei")]
    return docs, items


@pytest.mark.parametrize(("percent", "together"), [(100, 200_000), (100, 7), (60, 200_000)])
def test_against_brute_force(spark, monkeypatch, percent, together):
    monkeypatch.setattr(decontaminate, "TOGETHER", together)
    docs, items = sample()
    if together < 100:  # a scan for each block
        items = items[:6]
    d = spark.createDataFrame([(*r, 7, 8) for r in docs], "doc_id long, text string, key int, pos int").repartition(5)
    b = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, wid int")
    rows, hits = decontaminate.contamination(d, b, percent=percent)
    got = sorted((tuple(r) for r in decontaminate.digests(rows).collect()), key=repr)
    assert got == brute(docs, items, percent=percent)
    assert sum(r[2] for r in got) > 500 and hits.columns == ["key", "doc_id", "start", "len", "wid"]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    run = lambda x, y: [tuple(r) for r in decontaminate.digests(decontaminate.contamination(x, y)[0]).collect()]
    none = hashlib.sha256(b"").hexdigest()
    assert run(d.limit(0), b) == []
    assert run(d, b.limit(0)) == [(1, 2, 0, 0, none, False)]
    assert run(d, b) == [(1, 2, 2, 1, hashlib.sha256(b"1").hexdigest(), True)]


def test_only_dataframe_functions(spark):
    docs, items = sample()
    rows, _ = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(queries.QUERIES["op11_decontaminate"](spark, sf), connect(sf), queries.ORACLES["op11_decontaminate"]) is None
