"""Collapsed conversations against brute force and SQL."""

import random

import pytest

from auditmill.llm import chat, queries
from tools.check import compare, connect


def brute(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn, role, text))
    none = lambda x: (x is not None, x if x is not None else 0)
    for c in convs:
        convs[c].sort(key=lambda t: (none(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
    said = {c: [(r, t) for _, r, t in v] for c, v in convs.items()}
    out = {}
    for c, v in said.items():
        def beats(d):
            w = said[d]
            return d != c and len(w) >= len(v) and w[:len(v)] == v and (len(w) > len(v) or (d is not None and (c is None or d < c)))
        if not any(beats(d) for d in said):
            out[c] = "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in v)
    return out


@pytest.mark.parametrize("together", [1024, 3])
def test_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(chat, "TURNS_TOGETHER", together)
    rng = random.Random(4)
    rows = []
    for c in range(120):
        base = rng.randrange(12)
        rows += [(c, t, ["user", "assistant"][t % 2], f"b{base} t{t}" if rng.random() < 0.97 else "odd") for t in range(rng.randint(1, 9))]
    rows += [(200, 0, None, None), (201, 0, None, None), (201, 1, "user", None), (None, 0, "user", "hello"), (300, None, "user", "x"), (300, 5, "user", "y"), (301, 1, "user", "x"),
             (302, 1, "user", "tie a"), (302, 1, "user", "tie b"), rows[0], rows[0], (400, 0, "user", "b0 t0")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = chat.maximal_conversations(df).collect()
    text = {}
    for r in sorted(got, key=lambda r: r.part):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert text == brute(rows)
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_runs_without_python(spark):
    plan = queries.QUERIES["op5_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op5_chat"](spark, sf), connect(sf), queries.ORACLES["op5_chat"]) is None
