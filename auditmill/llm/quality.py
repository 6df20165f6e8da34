"""Quality filter by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams (bytes inside a line of text, pairs of words and begins of words),
one of the target text (documents that the labels accept) and one of the raw text (all documents),
give each document a log importance weight.  A document is as good as its worst passage: the weight
is the least log ratio of any ``PASSAGE`` consecutive bytes, so a few foul words are not outweighed
by a long text.  Gumbel noise on the weights and keeping the k largest is sampling without
replacement in proportion to the weights; k is the number of documents on the accepted side of the
cut that separates a held-out fold of the labels best.

Defined results: texts that are null or empty have weight 0, as there is nothing against them;
without accepted or without rejected labels everything is kept; of several labels of a document
any rejection wins; rows that repeat an id are kept or dropped together if their texts are equal.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from auditmill.llm.common import dense_rank_in, mix, python_ready
from auditmill.session import materialize

GRAM = 5  # bytes
HEADS = (5, 7)  # bytes at the begin of a word
GRAMS, PAIRS, BEGINS = 1 << 18, 1 << 19, 1 << 18  # buckets
TOGETHER = 1 << 19  # bytes of text that are worked on at a time
PASSAGE = 32  # bytes
#: Counts at which the evidence of a bucket weighs half: rare n-grams say little.
PRIORS = np.array([20.0, 5.0, 20.0])
EDGES = np.array([0, GRAMS, GRAMS + PAIRS, GRAMS + PAIRS + BEGINS])
LABELLED = 200_000  # labels that are used at most
FOLDS = 4  # one of them sets the cut
BASE = 0x9E3779B97F4A7C15

#: 0 white space, 1 word, 2 anything else
KIND = np.array([0 if chr(b) in " \t\n\r\x0b\x0c" else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for ``n`` bytes."""
    out = []
    for x in (BASE, pow(BASE, -1, 2**64)):
        each = np.full(n + 1, x, np.uint64)
        each[0] = 1
        out.append(np.multiply.accumulate(each))
    return out[0], out[1]


class Text:
    """Lower-cased texts one after the other, each ended by line ends, so that no n-gram spans two texts."""

    def __init__(self, texts: list[bytes]):
        end = b"\n" * GRAM
        data = np.frombuffer(b"".join(x + end for x in texts) + end, np.uint8)
        size = np.array([len(x) for x in texts], np.int64)
        self.at, begin = np.cumsum(np.concatenate([[0], size])), np.cumsum(size + GRAM) - size - GRAM
        n = len(data) - GRAM
        text = np.repeat(np.arange(len(size)), size)
        mine = np.arange(len(text)) + GRAM * text  # places of the texts' own bytes
        ahead, back = powers(max(2 * TOGETHER, 1 << (len(data) + 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * ahead[: len(data)])])
        self.grams = (mix((sums[mine + GRAM] - sums[mine]) * back[mine]) % np.uint64(GRAMS)).astype(np.int64)
        kind = KIND[data[:n]]
        edges = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(kind[1:] != kind[:-1]) + 1, np.full(1, n)])
        words = np.flatnonzero(kind[edges[:-1]] > 0) if n else np.zeros(0, np.int64)
        first = edges[words]
        word = mix((sums[edges[words + 1]] - sums[first]) * back[first] + np.uint64(1))
        self.owner = np.searchsorted(begin, first, side="right") - 1
        self.start = first - GRAM * self.owner
        before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[: len(word)]
        before[np.concatenate([[True], self.owner[1:] != self.owner[:-1]])[: len(word)]] = 0
        self.pairs = (mix(before * np.uint64(BASE) + word) % np.uint64(PAIRS)).astype(np.int64)
        stop = edges[words + 1]
        self.begins = [(mix((sums[np.minimum(first + k, stop)] - sums[first]) * back[first] + np.uint64(k)) % np.uint64(BEGINS)).astype(np.int64) for k in HEADS]

    def weights(self, ratio: np.ndarray) -> np.ndarray:
        """Least sum over a passage of each text; ``ratio`` holds the buckets of grams, of pairs and of begins."""
        each = ratio[self.grams].astype(np.float64)
        each[self.start] += ratio[GRAMS + self.pairs] + sum(ratio[GRAMS + PAIRS + b] for b in self.begins)
        total = np.concatenate([np.zeros(1), np.cumsum(each)])
        size = np.diff(self.at)
        last = np.minimum(np.arange(len(each)) + PASSAGE, np.repeat(self.at[1:], size))
        out, full = np.zeros(len(size)), np.flatnonzero(size)
        if len(full):
            out[full] = np.round(np.minimum.reduceat(total[last] - total[:-1], self.at[full]), 4)
        return out


def groups(texts: list[str | None]):
    """Lower-cased texts as bytes, about ``TOGETHER`` at a time, with the place of the first."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").lower().encode())
        size += len(held[-1])
        if size >= TOGETHER:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``_accepted`` (null without a label) and ``_fold`` to ``docs``.

    At most ``LABELLED`` labelled ids are used, those with the smallest hashes: a bounded broadcast.
    """
    verdict = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.min((F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("_accepted"))
    some = verdict.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)))
    return docs.join(F.broadcast(some), docs["doc_id"] == F.col("_id"), "left").drop("_id")


def log_ratios(docs: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket, from counts over all ``docs(text, _accepted, _fold)``."""
    def run(batches):
        counts = np.zeros((2, EDGES[-1]), np.int64)
        for batch in batches:
            target = np.array([bool(a) and f != 0 for a, f in zip(batch["_accepted"].to_pylist(), batch["_fold"].to_pylist(), strict=True)])
            for first, part in groups(batch["text"].to_pylist()):
                t, good = Text(part), target[first:first + len(part)]
                inside = np.repeat(good, np.diff(t.at))
                told = good[t.owner]
                for row, grams, words in ((0, slice(None), slice(None)), (1, inside, told)):
                    counts[row, : EDGES[1]] += np.bincount(t.grams[grams], minlength=GRAMS)
                    counts[row, EDGES[1]: EDGES[2]] += np.bincount(t.pairs[words], minlength=PAIRS)
                    for begins in t.begins:
                        counts[row, EDGES[2]:] += np.bincount(begins[words], minlength=BEGINS)
        seen = np.flatnonzero(counts[0])
        for a in range(0, len(seen), 1 << 16):
            k = seen[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[0, k]), pa.array(counts[1, k])], names=["bucket", "raw", "target"])

    parts = python_ready(docs.select("text", "_accepted", "_fold")).mapInArrow(run, "bucket long, raw long, target long")
    table = materialize(parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "ngrams")
    share = np.zeros(3)
    part_of = sum((F.col("bucket") >= int(e)).cast("int") for e in EDGES[1:-1])
    for r in table.groupBy(part_of.alias("part")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        share[r.part] = r.target / r.raw

    def pack(batches):
        """A batch of buckets as two binaries: little goes to the driver, and nothing row by row."""
        for batch in batches:
            bucket, raw, target = (batch[c].to_numpy() for c in ("bucket", "raw", "target"))
            part = np.searchsorted(EDGES[1:-1], bucket, side="right")
            told = share[part] > 0
            bucket, raw, target, part = bucket[told], raw[told], target[told], part[told]
            ratio = np.log((target + PRIORS[part] * share[part]) / (share[part] * (raw + PRIORS[part])))
            yield pa.RecordBatch.from_arrays([pa.array([bucket.astype("<u4").tobytes()]), pa.array([ratio.astype("<f4").tobytes()])], names=["bucket", "ratio"])

    out = np.zeros(EDGES[-1], np.float32)
    for r in python_ready(table).mapInArrow(pack, "bucket binary, ratio binary").toLocalIterator():  # eight bytes a bucket
        out[np.frombuffer(r.bucket, "<u4")] = np.frombuffer(r.ratio, "<f4")
    return out


def best_cut(weighed: DataFrame) -> float:
    """The cut that keeps most accepted and drops most rejected documents of the held-out fold; keeping counts twice."""
    level = (F.floor(F.greatest(F.col("weight"), F.lit(-1000.0)) * 4) / 4).alias("level")  # at most a few thousand levels
    rows = weighed.filter("_fold = 0").groupBy(level, "_accepted").agg(F.count(F.lit(1)).alias("n")).collect()
    good, bad = ({r.level: r.n for r in rows if r["_accepted"] is x} for x in (True, False))
    if not good or not bad:
        return float("-inf")
    n_good, n_bad = sum(good.values()), sum(bad.values())
    best, cut, lost, caught = 2.0, float("-inf"), 0, 0
    for level_ in sorted({*good, *bad}):
        value = 2 * (1 - lost / n_good) + caught / n_bad
        if value > best:
            best, cut = value, level_
        lost, caught = lost + good.get(level_, 0), caught + bad.get(level_, 0)
    return cut


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``weight``, ``key`` and ``selected``; all other columns are kept.

    ``labels`` has doc_id, quality and toxic; quality 1 and toxic 0 is accepted.
    """
    ratio = log_ratios(labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels))
    rest = docs.drop("weight", "key", "selected", "_tie", "_accepted", "_fold")
    schema = T.StructType([*rest.schema.fields, T.StructField("weight", T.DoubleType(), False)])
    names = rest.columns
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def run(batches):
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for first, part in groups(batch["text"].to_pylist()):
                weight[first:first + len(part)] = Text(part).weights(sent.value)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(weight)], names=schema.names)

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = materialize(python_ready(rest).mapInArrow(run, schema).withColumns({
        "key": F.col("weight") - F.log(-F.log(uniform)), "_tie": F.xxhash64("doc_id", "text")}), "weighed")
    cut = best_cut(labelled(weighed.select("doc_id", "weight"), labels))
    k = weighed.filter(F.col("weight") >= cut).count()
    # a bucket holds the keys of one hundredth, so there are some ten thousand of them however many rows
    keys = weighed.select("key", "_tie")
    last = dense_rank_in(keys, [], [F.desc("key"), F.desc("_tie")], F.floor(F.greatest(F.col("key"), F.lit(-1000.0)) * -100), "r").filter(F.col("r") == k - 1).first()
    if last is None:
        return weighed.withColumn("selected", F.lit(False)).drop("_tie")
    chosen = F.struct("key", "_tie") >= F.struct(F.lit(last["key"]).alias("key"), F.lit(last["_tie"]).alias("_tie"))
    return weighed.withColumn("selected", chosen).drop("_tie")
