"""Cheapest repairs against all edit sequences, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from auditmill.llm import queries, repair
from tools.check import compare, connect

LEGAL = re.compile(r"(s?(ua)+)?")


def fault_of(text, role, seen):
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def cheapest(rows):
    """Least (cost, audit) and the repaired rows, over all edits with up to two inserts in a gap."""
    seen, faults = set(), []
    for role, text in rows:
        faults.append(fault_of(text, role, seen))
        seen.add((role, text))
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, inserts)) > 3:
                continue
            out, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                for role in inserts[i]:
                    out.append(({"u": "user", "a": "assistant"}[role], ""))
                    audit, cost = audit + "I", cost + 5
                if i < len(rows):
                    audit += edits[i][0]
                    if edits[i] == "D":
                        cost += 2
                        continue
                    cost += (edits[i] != "K") + 5 * (faults[i] == "truncated")
                    role = rows[i][0] if edits[i] == "K" else {"u": "user", "a": "assistant"}[edits[i][1]]
                    out.append((role, rows[i][1]))
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return faults, best


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}\x01{t[2]}".encode()).digest()))
        faults, (cost, audit, kept) = cheapest([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows():
    rng, rows = random.Random(5), []
    for conv in range(70):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn + (rng.random() < 0.2), rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]),
                         rng.choice(["Hi.", "So?", "cut off", "Yes! ", "", " \n", "ok.", "ü ", "end. "])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (100, None, "user", "a."), (100, None, "assistant", "b."), (101, 3, None, None),
             (101, 5, "", "x."), (102, 1, "user", "tie a."), (102, 1, "user", "tie b."), (102, 1, "user", "tie b."), (103, 0, "user", None)]
    return rows


def test_against_all_edits(spark):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, gid int, mark string").repartition(3)
    plans, turns = repair.repair(df)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(turns, plans).collect()}
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    got = sorted(((*(r[n] for n in names), digests[r.conv_id]) for r in plans.collect()), key=repr)
    assert got == brute(rows)
    # the repaired rows give the digests
    said = {}
    for r in repair.repaired(turns, plans).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(r)
    for r in got:
        lines = said.get(r[0], [])
        assert [x.place for x in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines).encode()).hexdigest() == r[-1]
        assert LEGAL.fullmatch("".join(x.role[:1] for x in lines))
        assert "".join(x.edit for x in lines) == r[-2].replace("D", "")


def test_spans_in_any_cut_give_the_same():
    rng = random.Random(2)
    for _ in range(200):
        cells = [repair.LEXICAL[rng.choice(["s", "u", "a", ""]), rng.randrange(4)] for _ in range(rng.randint(1, 40))]
        one = repair.answer(repair.chart(cells))
        left = cells[0]
        for c in cells[1:]:
            left = repair.combined(left, c)
        cut = rng.randrange(len(cells) + 1)
        halves = [repair.chart(c) for c in (cells[:cut], cells[cut:]) if c]
        assert one == repair.answer(left) == repair.answer(repair.chart(halves))
        assert len(one[1].replace("I", "")) == len(cells)


def test_long_conversation_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, ["user", "assistant"][t % 2] if t % 97 else "assistant", f"turn {t}.") for t in range(5_000)]
        rows += [(2, 0, "user", "same."), *[(2, t, "user", "same.") for t in range(1, 3_000)], (3, 0, "user", "long. " * 200_000)]
        plans, turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
        got = {r.conv_id: r for r in plans.collect()}
        assert turns.select("gid").agg({"gid": "max"}).first()[0] > 1 << 33  # more than one range
        cells = [repair.LEXICAL[r[2][0], 0] for r in rows[:5_000]]
        assert (got[1].cost, got[1].audit) == repair.answer(repair.chart(cells))
        assert got[2].duplicate == 2_999 and got[2].cost == 6_000 and got[2].audit == "D" * 3_000
        assert got[3].audit == "D" and got[1].gaps == 0
        assert repair.repaired(turns, plans).filter("conv_id = 1").count() == len(got[1].audit) - got[1].audit.count("D")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_damage(spark):
    rows = [(c, t, "assistant" if c else None, "One. Two! Three?" if t else None) for c in range(30) for t in range(20)] + [(None, None, "user", "x.")]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(code, [(role, text)])
        assert got.get((c, t), []) == want


def test_empty_table_and_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert repair.damage_and_repair(df.limit(0)).count() == 0
    row = repair.damage_and_repair(df).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(queries.QUERIES["op12_repair"](spark, sf), connect(sf), queries.ORACLES["op12_repair"]) is None


@pytest.mark.parametrize("roles", ["", "s", "ua", "sua", "uaua"])
def test_legal_conversations_stay(roles):
    cells = [repair.LEXICAL[r, 0] for r in roles]
    want = (0, "K" * len(roles)) if roles != "s" else (2, "D")
    assert (repair.answer(repair.chart(cells)) if cells else repair.answer(repair.CLOSURE)) == want
