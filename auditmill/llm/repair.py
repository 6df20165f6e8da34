"""Conversations brought into a legal order of roles by the cheapest edits: weighted interval parsing (CYK).

Legal role initials are ``(s?(ua)+)?``.  The four states of that pattern (start, after system, after
user, after assistant) give a grammar in Chomsky normal form: a symbol (p, q) for each pair of
states, read as "leads from p to q", with rules (p, q) -> (p, r) (r, q).  A row is a lexical rule for
each edit it allows: Keep (0), Rerole to user or assistant (1), Delete (2, the only one for blank and
repeated rows); keeping or reroling a truncated row costs 5 more.  Inserting an empty row (5) is
a rule over nothing; its closure is taken once before every row and once at the end.

A cell of the chart holds, for a span of rows and each symbol, the least (cost, audit): ``audit``
spells the edits in order by their initials, ties go to the ASCII-least.  Spans are combined bottom-up by
length.  Every derivation over a span passes some state at any given split, so one split per span
finds the least one, and spans double in length.  Two audits of equal cost over the same rows
never begin with one another (the longer one would hold more inserts and cost more), so the least audit of a whole is
made of the least audits of its parts.

Spark deals rows by ranges of (conversation, turn), however long a conversation is; a task combines
the spans of its rows, and the few spans of a conversation that is spread over tasks are combined after.
What a row said stays out of the parsing; texts are joined with the edits at the end and streamed.

Defined results: rows go by turn (null first), then by a digest of role and text; a null role or text
is one blank; rows with a null conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditmill.llm.common import python_ready
from auditmill.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_KEPT = 5
#: How a role initial moves on from a state.
MOVES = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
FAULTS = {"none": 0, "blank": 1, "duplicate": 2, "truncated": 3}

Cell = list  # for each pair of states p * 4 + q the least (cost, audit), or None


def least(cell: Cell, at: int, cost: int, audit: str) -> None:
    if cell[at] is None or (cost, audit) < cell[at]:
        cell[at] = (cost, audit)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that follow each other."""
    out = [None] * STATES ** 2
    for p in range(STATES):
        for r in range(STATES):
            a = left[p * STATES + r]
            if a is None:
                continue
            for q in range(STATES):
                b = right[r * STATES + q]
                if b is None:
                    continue
                at, cost = p * STATES + q, a[0] + b[0]
                if out[at] is None or cost <= out[at][0]:
                    least(out, at, cost, a[1] + b[1])
    return out


def inserted() -> Cell:
    """What inserted rows alone lead to, from nothing on."""
    one = [None] * STATES ** 2
    for initial in "ua":
        for p, q in MOVES[initial]:
            one[p * STATES + q] = (COST[INSERT], INSERT)
    closed = [(0, "") if p == q else None for p in range(STATES) for q in range(STATES)]
    for _ in range(STATES):
        for at, found in enumerate(combined(closed, one)):
            if found is not None:
                least(closed, at, *found)
    return closed


CLOSURE = inserted()


def lexical(initial: str, fault: int) -> Cell:
    """The edits of one row, with what may be inserted before it."""
    cell = [(COST[DELETE], DELETE) if p == q else None for p in range(STATES) for q in range(STATES)]
    if fault not in (FAULTS["blank"], FAULTS["duplicate"]):
        more = TRUNCATED_KEPT if fault == FAULTS["truncated"] else 0
        for p, q in MOVES.get(initial, []):
            least(cell, p * STATES + q, COST[KEEP] + more, KEEP)
        for p, q in MOVES["u"] + MOVES["a"]:
            least(cell, p * STATES + q, COST[REROLE] + more, REROLE)
    return combined(CLOSURE, cell)


LEXICAL = {(i, f): lexical(i, f) for i in ("s", "u", "a", "") for f in FAULTS.values()}


def chart(cells: list[Cell]) -> Cell:
    """The cell of all spans together, bottom-up by length."""
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def answer(cell: Cell) -> tuple[int, str]:
    whole = combined(cell, CLOSURE)
    return min(whole[START * STATES + q] for q in (START, ASSISTANT) if whole[START * STATES + q] is not None)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows numbered by ``gid`` in the order of conversations and turns, with their role initial and own faults."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("mark", F.unhex(F.md5(F.concat("role", F.lit("\x01"), "text"))))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("mark")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id())
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return materialize(dealt.withColumns({
        "initial": F.substring("role", 1, 1), "blank": end == "",
        "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")}), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(gid, conv_id, turn, initial, fault): the first fault of every row, without what it says."""
    said = turns.groupBy("conv_id", "mark").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    said = said.select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark"))
    fault = F.when(F.col("blank"), FAULTS["blank"]).when(F.col("gid") > F.col("first"), FAULTS["duplicate"]).when(
        F.col("cut"), FAULTS["truncated"]).otherwise(FAULTS["none"])
    return turns.drop("text").join(said, same, "left").select("gid", "conv_id", "turn", "initial", fault.alias("fault"))


SPAN = "conv_id {}, gid long, first string, last string, illegal long, cost array<long>, audit array<string>"


class Span:
    """Rows of a conversation that follow each other: their cell, border initials and illegal neighbours."""

    def __init__(self, conv, gid, first, last, illegal, cell):
        self.conv, self.gid, self.first, self.last, self.illegal, self.cell = conv, gid, first, last, illegal, cell

    def followed_by(self, other: Span) -> Span:
        illegal = self.illegal + other.illegal + (self.last + other.first not in ("su", "ua", "au"))
        return Span(self.conv, self.gid, self.first, other.last, illegal, combined(self.cell, other.cell))


def span_rows(spans: list[Span], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([s.conv for s in spans], kind), pa.array([s.gid for s in spans], pa.int64()),
        pa.array([s.first for s in spans], pa.string()), pa.array([s.last for s in spans], pa.string()),
        pa.array([s.illegal for s in spans], pa.int64()),
        pa.array([[None if x is None else x[0] for x in s.cell] for s in spans], pa.list_(pa.int64())),
        pa.array([[None if x is None else x[1] for x in s.cell] for s in spans], pa.list_(pa.string())),
    ], names=["conv_id", "gid", "first", "last", "illegal", "cost", "audit"])


def follow(batches, spans_of):
    """The spans that ``spans_of`` reads from each batch, neighbours of one conversation combined; one is held."""
    held, kind = None, None
    for batch in batches:
        done, kind = [], batch["conv_id"].type
        for span in spans_of(batch):
            if held is None:
                held = span
            elif held.conv == span.conv:
                held = held.followed_by(span)
            else:
                done.append(held)
                held = span
        if done:
            yield span_rows(done, kind)
    if held is not None:
        yield span_rows([held], kind)


def of_rows(batch):
    """Spans of the rows of a batch, one for each conversation in it."""
    conv, gid, initial, fault = (batch[c].to_pylist() for c in ("conv_id", "gid", "initial", "fault"))
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            illegal = sum(initial[i] + initial[i + 1] not in ("su", "ua", "au") for i in range(a, b - 1))
            cells = [LEXICAL[initial[i] if initial[i] in MOVES else "", fault[i]] for i in range(a, b)]
            yield Span(conv[a], gid[a], initial[a], initial[b - 1], illegal, chart(cells))


def of_spans(batch):
    for r in batch.to_pylist():
        cell = [None if c is None else (c, a) for c, a in zip(r["cost"], r["audit"], strict=True)]
        yield Span(r["conv_id"], r["gid"], r["first"], r["last"], r["illegal"], cell)


def parsed(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of ``rows(gid, conv_id, initial, fault)``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def by_rows(batches):
        yield from follow(batches, of_rows)

    def by_spans(batches):
        for batch in follow(batches, of_spans):
            told = [answer(s.cell) for s in of_spans(batch)]
            yield pa.RecordBatch.from_arrays([
                batch["conv_id"], batch["illegal"], pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.string()),
            ], names=["conv_id", "illegal", "cost", "audit"])

    dealt = rows.select("gid", "conv_id", "initial", "fault").repartitionByRange("gid").sortWithinPartitions("gid")
    spans = python_ready(dealt).mapInArrow(by_rows, SPAN.format(kind))
    return spans.repartition("conv_id").sortWithinPartitions("conv_id", "gid").mapInArrow(by_spans, f"conv_id {kind}, illegal long, cost long, audit string")


def edited(batches):
    """(batch, rows) of conversations in order: each starts with its audit (kind 0), then come its rows.

    ``rows`` are (conv_id, place, role, text, edit) of what stays; ``edit`` is null where a conversation begins.
    """
    audit, at, place, odd = "", 0, 0, 0

    def named():
        return "user" if (place - odd) % 2 == 0 else "assistant"

    for batch in batches:
        rows = []
        for conv, kind, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                audit, at, place = text, 0, 0
                odd = (len(audit) - audit.count(DELETE)) % 2  # an odd number begins with a system row
                rows.append((conv, 0, None, None, None))
            else:
                edit, at = audit[at], at + 1
                if edit != DELETE:
                    rows.append((conv, place, role if edit == KEEP else named(), text, edit))
                    place += 1
            while at < len(audit) and audit[at] == INSERT:
                rows.append((conv, place, named(), "", INSERT))
                at, place = at + 1, place + 1
        yield batch, rows


def with_audits(turns: DataFrame, plans: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "gid", "role", "text").unionByName(
        plans.select("conv_id", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("gid"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return python_ready(rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "gid"))


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch, rows in edited(batches):
            rows = [r for r in rows if r[4] is not None]
            types = [batch["conv_id"].type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    return with_audits(turns, plans).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows as ``role:text`` on a line each; holds no conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, digest, started = None, None, False
        for batch, rows in edited(batches):
            done = []
            for c, place, role, text, edit in rows:
                if edit is None:
                    if started:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, started = c, hashlib.sha256(), True
                else:
                    digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            yield told(done, batch["conv_id"].type)
        if started:
            yield told([(conv, digest.hexdigest())], batch["conv_id"].type)

    def told(rows, t):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], t), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    return with_audits(turns, plans).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``conversations(conv_id, turn, role, text)`` and its cheapest repair.

    First table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  Second: the ordered
    turns, from which ``repaired`` and ``repaired_digests`` make the repaired conversations.
    """
    turns = ordered_turns(conversations)
    rows = materialize(faults(turns), "faults")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = rows.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *[
        F.count(F.when(F.col("fault") == FAULTS[f], 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    plans = parsed(rows).withColumnRenamed("conv_id", "_conv")
    return materialize(counts.join(plans, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), "plans"), turns


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by a checksum of ``conv_id:turn``: a twentieth each is dropped, emptied,
    cut at its stops, repeated or said by the user.  Nulls are one blank here too."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                                F.pmod(F.crc32(key), F.lit(20)).alias("_code")).filter("_code <> 0")
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return rows.withColumn("_copy", copies).select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Every conversation damaged, then repaired: its faults, cost, audit and digest of what it became."""
    plans, turns = repair(damaged(conversations))
    digests = repaired_digests(turns, plans).withColumnRenamed("conv_id", "_conv")
    told = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    names = conversations.select(F.col("conv_id").alias("_all")).distinct()
    rows = names.join(told, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select(F.col("_all").alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
