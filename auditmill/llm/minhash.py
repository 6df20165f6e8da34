"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Every text becomes its set of hashed word shingles and a sketch.  The sketch throws the set
   into bins in rounds: in round i each shingle goes to one bin with a value; bins that are still
   empty take the smallest one.  From round ``SIZE`` on, bin after bin is served by all shingles,
   so after 2 * SIZE rounds every coordinate is filled, however small the set.  The share of equal
   coordinates is concentrated around the Jaccard similarity.
2. Equal sets form one class; only classes go on.
3. Classes that agree on a band of coordinates meet in a bucket.  First every member is verified
   against the bucket's smallest id, which links large groups of copies without all their pairs.
   Before any text is joined, one bit of each coordinate tells most pairs apart.
4. Where buckets still hold several components, sketches that may reach the threshold tie these
   to clusters, and inside a cluster texts of different components are compared on their full sets,
   block by block.  Tasks return the links that join components, never their pairs.
5. Verification is exact, on the full sets of both texts; components come from verified links only.

Two sets at the threshold 0.8 share none of 32 bands of 4 with probability 5e-8; a pair at the
threshold agrees on fewer than ``LEAST`` of its share of coordinates with about 1e-8.

Defined results: a null text or one without words has no set and links with nothing; with fewer words
than the shingle width the whole sequence is one shingle; equal rows are equal results; rows that
share an id are one document; ids are below 2 ** 62.  A null id takes part under a stand-in made of its
text, so near copies of it are found, but it never names a component: ``component_id`` is null where
no row of the component has an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill.llm.common import components, mix, python_ready, runs
from auditmill.session import materialize

SIZE, BAND = 128, 4
LEAST = 0.75  # share of the threshold that the sketches must show
#: Of SIZE single bits 0.9 agree at the threshold; fewer than 3/4 do with a probability of about 4e-7.
BITS_APART = SIZE // 4
BLOCK = 256
SLOTS = 1 << 26  # bits that tell which texts are asked for: 8 MB, however many there are
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; words are runs without ASCII white space, A-Z lowered."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + each[i:i + len(out)])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SIZE`` 32-bit coordinates for each set; rows of empty sets mean nothing."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.zeros((len(sets), SIZE), np.uint32)
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    todo = np.array([len(s) > 0 for s in sets])
    empty = np.ones((len(sets), SIZE), bool)
    for i in range(2 * SIZE):
        if not todo.any():
            break
        if not todo[owner].all():
            keep = todo[owner]
            element, owner = element[keep], owner[keep]
        h = mix(element + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = (h & np.uint64(SIZE - 1)).astype(np.int64) if i < SIZE else np.full(len(h), i - SIZE)
        best = np.full(out.size, none)
        np.minimum.at(best, owner * SIZE + to, h >> np.uint64(7))
        best = best.reshape(out.shape)
        new = empty & (best != none)
        out[new] = (best[new] * np.uint64(2 * SIZE) + np.uint64(i)).astype(np.uint32)  # low bits and the round
        empty &= ~new
        todo &= empty.any(axis=1)
    return out


STAND_INS = 1 << 62


def stand_in(text: Column) -> Column:
    """What stands for the null id of a row with this text; larger than every id."""
    return F.xxhash64(text).bitwiseAND(F.lit(STAND_INS - 1)).bitwiseOR(F.lit(STAND_INS))


def sketch_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch, bits) of whole texts; ``bits`` has one bit of each coordinate."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                sets = [shingles(t, width) for t in part["text"].to_pylist()]
                rows = sketches(sets)
                bits = np.packbits(rows >> np.uint32(8) & np.uint32(1), axis=1).view(np.int64)  # above the round
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([row.tobytes() for row in rows], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                ], names=["doc_id", "n_shingles", "set_key", "sketch", "bits1", "bits2"])

    return python_ready(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary, bits1 long, bits2 long")


def among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts(doc_id, text)`` that a join with ``ids(id)`` may need, so that it does not move all texts.

    Every id sets one of ``SLOTS`` bits; rows whose bit another id has set come along, and the join drops them.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    at = ids.select(slot("id").alias("s")).select(F.floor(F.col("s") / 64).alias("word"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("bit"))
    words = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            s = batch["slot"].to_numpy()
            asked = (sent.value[s >> 6] >> (s & 63) & 1).astype(bool)
            yield batch.select(["doc_id", "text"]).filter(pa.array(asked, pa.bool_()))

    return python_ready(texts.select("doc_id", "text", slot("doc_id").alias("slot"))).mapInArrow(run, "doc_id long, text string")


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    The text of ``a`` is followed by the texts of its partners, in blocks, so a task holds
    two sets at a time, however many partners one text has.
    """
    blocks = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    dealt = pairs.join(blocks, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), "_n").alias("block"))
    wanted = dealt.select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("id")).distinct().unionByName(
        dealt.select("a", "block", F.lit(1).alias("kind"), F.col("b").alias("id")))
    wanted = materialize(wanted, "wanted")
    rows = wanted.join(among(texts, wanted).select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "kind")

    def run(batches):
        first = None
        for batch in batches:
            a, b = [], []
            for anchor, kind, other, text in zip(*(batch[n].to_pylist() for n in ("a", "kind", "id", "text")), strict=True):
                own = shingles(text, width)
                if kind == 0:
                    first = own
                    continue
                common = len(np.intersect1d(first, own, assume_unique=True))
                if 100 * common >= percent * (len(first) + len(own) - common):
                    a.append(anchor)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return python_ready(rows).mapInArrow(run, "a long, b long").distinct()


def in_pairs_of_blocks(rows: DataFrame, by: list[str], count: str, block: int) -> DataFrame:
    """Deal the ``count`` rows of a group to blocks; every two blocks (lo, hi) meet in one task."""
    n = F.ceil(F.col(count) / block)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), n)).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", count)


class Labels:
    """Components that are joined step by step inside a task."""

    def __init__(self, comp: np.ndarray):
        self.names, self.label = np.unique(comp, return_inverse=True)

    def join(self, i: int, j: int) -> bool:
        """Whether rows i and j were apart until now."""
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == b] = a
        return a != b


def alike_components(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that span what the sketches find alike in open buckets.

    Members of a bucket are dealt to blocks and two blocks compared in a task, which returns a
    spanning forest over the components in it, never its pairs.
    """
    cells = in_pairs_of_blocks(members, ["bucket", "band"], "c", BLOCK)
    cells = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "band", "lo", "hi")
    least = int(LEAST * percent / 100 * SIZE)

    def run(batches):
        for (_, _, lo, hi), t in runs(batches, ["bucket", "band", "lo", "hi"]):
            own, comp, n = (t[c].to_numpy() for c in ("own", "comp", "n"))
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(-1, SIZE)
            labels, found = Labels(comp), []
            right = np.flatnonzero(own == hi)
            for i in np.flatnonzero(own == lo):
                other = right[(labels.label[right] != labels.label[i]) & (100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right]))]
                for j in other[(sketch[other] == sketch[i]).sum(axis=1) >= least]:
                    if labels.join(i, j):
                        found.append((min(comp[i], comp[j]), max(comp[i], comp[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b"])

    return python_ready(cells).mapInArrow(run, "a long, b long").distinct()


def cluster_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each cluster: ``members(cluster, m, rep, comp)``.

    Exact on full sets.  Blocks of a cluster meet in pairs; a task returns the links that join
    components in it, and leaves out what these have joined already.
    """
    asked = among(texts, members.select(F.col("rep").alias("id")))
    cells = in_pairs_of_blocks(members, ["cluster"], "m", BLOCK // 2).join(asked.select(F.col("doc_id").alias("rep"), "text"), "rep")
    cells = cells.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")

    def run(batches):
        for (_, lo, hi), t in runs(batches, ["cluster", "lo", "hi"]):
            own, rep, comp = (t[c].to_numpy() for c in ("own", "rep", "comp"))
            labels, found = Labels(comp), []
            if len(labels.names) < 2:
                continue
            sets = [shingles(x.as_py(), width) for x in t["text"]]
            n = np.array([len(x) for x in sets])
            right = np.flatnonzero(own == hi)
            flat, owner = np.concatenate([sets[j] for j in right] + [np.zeros(0, np.uint64)]), np.repeat(right, n[right])
            for i in np.flatnonzero((own == lo) & (n > 0)):
                may = (labels.label != labels.label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                if not may[right].any():
                    continue
                at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
                common = np.bincount(owner[sets[i][at] == flat], minlength=len(n))
                for j in right[may[right] & (100 * common >= percent * (n + n[i] - common))[right]]:
                    if labels.join(i, j):
                        found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b"])

    return python_ready(cells).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept; and ``row_id``
    (the id or its stand-in) and ``leads`` (whether the row is the first of its component)."""
    unnamed = F.col("doc_id").isNull()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.filter(~unnamed).unionByName(texts.filter(unnamed).select(stand_in(F.col("text")).alias("doc_id"), "text"))
    sets = materialize(sketch_table(texts, width), "sets")
    classes = materialize(
        sets.filter("n_shingles > 0").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bits1").alias("bits1"), F.first("bits2").alias("bits2")), "classes")
    # equal texts without ids share a stand-in
    standing = F.col("doc_id") >= STAND_INS
    named = texts.filter(~standing).unionByName(texts.filter(standing).dropDuplicates(["doc_id"]))

    bands = F.posexplode(F.array(*[F.xxhash64(F.substring("sketch", 4 * BAND * i + 1, 4 * BAND), F.lit(i)) for i in range(SIZE // BAND)])).alias("band", "bucket")
    bucket = Window.partitionBy("bucket", "band")
    met = materialize(classes.select("rep", "n", bands).withColumns({
        "head": F.min(F.struct("rep", "n")).over(bucket), "c": F.count(F.lit(1)).over(bucket)}).filter("c > 1"), "met")
    close = 100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")
    meet = met.filter((F.col("rep") != F.col("head.rep")) & close).select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()
    # bits are fetched for pairs, as they would be most of what the buckets move
    bits = lambda c: classes.select(F.col("rep").alias(c), F.array("bits1", "bits2").alias(f"{c}_bits"))
    apart = sum(F.bit_count(F.get("a_bits", i).bitwiseXOR(F.get("b_bits", i))) for i in range(2))
    first = meet.join(bits("a"), "a").join(bits("b"), "b").filter(apart <= BITS_APART).select("a", "b")
    links = materialize(verify(first, named, width, percent), "links")
    found = components(links)

    told = met.filter("c > 2").select("rep", "n", "bucket", "band", "c").join(found, F.col("rep") == F.col("node"), "left").select(
        "rep", "n", "bucket", "band", "c", F.coalesce("component", "rep").alias("comp"))
    told = materialize(told, "told")
    still = told.groupBy("bucket", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").drop("x", "y")
    members = told.join(still, ["bucket", "band"]).join(classes.select("rep", "sketch"), "rep")
    alike = materialize(alike_components(members, percent), "alike")
    final = found
    if not alike.isEmpty():
        clusters = components(alike).withColumnRenamed("component", "cluster")
        whole = classes.join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp"))
        inside = materialize(whole.join(clusters, F.col("comp") == F.col("node")).select("cluster", "rep", "comp"), "clusters")
        sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
        more = materialize(cluster_links(inside.join(sizes, "cluster"), named, width, percent), "links")
        if not more.isEmpty():
            final = components(links.unionByName(more))
    named_classes = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("set_key").alias("_key"), F.coalesce("component", "rep").alias("_component"))
    found = sets.select("doc_id", "n_shingles", "set_key").join(named_classes, F.col("set_key") == F.col("_key"), "left")
    known = lambda c: F.when(F.col(c) < STAND_INS, F.col(c))
    rows = found.withColumn("_component", F.coalesce("_component", "doc_id")).select(
        known("doc_id").alias("doc_id"), "n_shingles", known("_component").alias("component_id"),
        F.col("doc_id").alias("row_id"), (F.col("doc_id") == F.col("_component")).alias("leads"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row_id", "leads")
