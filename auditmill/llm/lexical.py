"""Ranked lexical search: impact-sorted lists read in order, with a lower and an upper score per document (NRA).

1. Every document becomes its terms and their counts; what the search terms need of the whole table
   (documents, length, document frequencies) is counted over all of it.
2. A posting's impact is its exact integer share of a score, known before any item is scored.
3. Documents are dealt to shards of at most ``DOCS_TOGETHER`` on average and items to blocks; a cell is
   a shard and a block.  It holds the postings of its documents for the terms asked in its block, one
   list for each term, by descending impact.
4. In a cell each item reads its lists from the top, in rounds.  A document's lower bound is what was
   read of it, its upper bound adds the last impact read of every list it was not met in.  Once no
   unmet document can reach the k-th lower bound, the lists are followed only for those that still
   can, until their bounds have met.  So members, ties and scores are exact when reading stops.
5. The best of the shards are ranked once more; each adds k rows for an item at most.

The hot key here is a frequent term: its postings are dealt by document, never gathered by term.

Defined results: null or empty texts have no term and are no document of the statistics; every row is
a document of its own, also with a repeated or null id; equal scores go to the smaller id, null last;
rows that share an item_id (null included) are one item, with the terms of all; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from auditmill.llm.common import python_ready, runs
from auditmill.session import materialize

#: Documents of a shard and items of a block on average; both bound what a task holds.
DOCS_TOGETHER, ITEMS_TOGETHER = 8_192, 1_024
#: Up to so many different search terms are sent to the tasks, which then pass on no others.
TERMS_SENT = 200_000
#: Entries of each list that the first round reads; every round reads twice as many.
FIRST_READ = 64

#: ASCII bytes that stand between terms become blanks, A-Z become a-z, others stay.
CLASSES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def counted_terms(rows: DataFrame, only=None) -> DataFrame:
    """``rows(key, id, text)`` to (key, id, n, terms, times): n counts all terms, the lists hold those of ``only``."""
    sent = None if only is None else rows.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        wanted = None if sent is None else sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part, n, terms, times, ends = batch.slice(a, 64), [], [], [], [0]
                for text in part["text"].cast(pa.binary()).to_pylist():
                    held = Counter((text or b"").translate(CLASSES).split())
                    n.append(sum(held.values()))
                    named = held if wanted is None else wanted & held.keys()
                    terms += named
                    times += [held[t] for t in named]
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part["key"], part["id"], pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
                ], names=["key", "id", "n", "terms", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    return python_ready(rows).mapInArrow(run, f"key long, id {kind}, n long, terms array<string>, times array<long>")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of documents 0 to n_docs - 1 with a score above 0, and their scores.

    ``lists`` are (documents, impacts), by descending impact; equal scores go to the smaller ``order``.
    """
    low, read = np.zeros(n_docs, np.int64), FIRST_READ
    at = [0] * len(lists)
    while True:
        for i, (docs, impact) in enumerate(lists):
            part = slice(at[i], at[i] + read)
            low[docs[part]] += impact[part]
            at[i] = min(at[i] + read, len(docs))
        last = [int(impact[at[i]]) if at[i] < len(impact) else 0 for i, (_, impact) in enumerate(lists)]
        total = sum(last)
        if not total:
            break
        limit = np.partition(low, n_docs - k)[n_docs - k] if n_docs >= k else 0
        if total < limit:  # no unmet document gets there
            gap = np.full(n_docs, total, np.int64)
            for i, (docs, _) in enumerate(lists):
                gap[docs[:at[i]]] -= last[i]
            may = (low > 0) & (low + gap >= limit)
            if not gap[may].any():
                break
            # what was read stays known, of the rest only the documents that may get there are followed
            for i, (docs, impact) in enumerate(lists):
                rest = may[docs[at[i]:]]
                lists[i] = (np.concatenate([docs[:at[i]], docs[at[i]:][rest]]), np.concatenate([impact[:at[i]], impact[at[i]:][rest]]))
        read *= 2
    found = np.flatnonzero(low > 0)
    found = found[np.lexsort((order[found], -low[found]))][:k]
    return found, low[found]


def search_cells(rows: DataFrame, k: int) -> DataFrame:
    """``rows(block, shard, kind, key, doc_id, tid, impact, tids)``: in each cell items (kind 0), then postings."""
    rows = rows.repartition("block", "shard").sortWithinPartitions("block", "shard", "kind", "tid", F.desc("impact"), "key")

    def run(batches):
        for _, t in runs(batches, ["block", "shard"]):
            kind, key, tid, impact = (t[c].to_numpy() for c in ("kind", "key", "tid", "impact"))
            n = int((kind == 0).sum())
            asked = t["tids"].slice(0, n).to_pylist()
            if n == len(kind):
                continue
            names, first, doc = np.unique(key[n:], return_index=True, return_inverse=True)
            ids = t["doc_id"].slice(n).take(pa.array(first))
            order = np.empty(len(names), np.int64)  # by id, null last, then row
            order[pc.sort_indices(pa.table({"i": ids, "k": names}), sort_keys=[("i", "ascending"), ("k", "ascending")]).to_numpy()] = np.arange(len(names))
            terms, start = np.unique(tid[n:], return_index=True)
            end = np.append(start[1:], len(doc))
            list_of = {w: (doc[a:b], impact[n + a:n + b]) for w, a, b in zip(terms.tolist(), start, end, strict=True)}
            for q, tids in zip(key[:n].tolist(), asked, strict=True):
                lists = [list_of[w] for w in tids if w in list_of]
                if not lists:
                    continue
                found, score = nra(lists, len(names), order, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found), q)), ids.take(pa.array(found)).combine_chunks(), pa.array(names[found]), pa.array(score),
                ], names=["q", "doc_id", "key", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return python_ready(rows).mapInArrow(run, f"q long, doc_id {kind}, key long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``: item_id, rank, doc_id, score."""
    number = F.monotonically_increasing_id()
    said = counted_terms(items.select(F.lit(0).cast("long").alias("key"), F.col("item_id").alias("id"), "text"))
    asked = materialize(said.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
                        .withColumn("q", number), "items")
    terms = materialize(asked.select(F.explode("terms").alias("term")).distinct().withColumn("tid", number), "terms")
    only = {r.term.encode() for r in terms.select("term").collect()} if terms.count() <= TERMS_SENT else None

    texts = docs.select(number.alias("key"), F.col("doc_id").alias("id"), "text")
    index = materialize(counted_terms(texts, only), "index")
    held = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    postings = index.select("key", F.col("id").alias("doc_id"), "n", F.explode(F.arrays_zip("terms", "times")).alias("t")).select(
        "key", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
    ratio = F.lit(2.0 * held["docs"] + 2) / (2 * F.col("df") + 1).cast("double")
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term").select(
        "tid", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("w"))
    blocks = max(1, -(-asked.count() // ITEMS_TOGETHER))
    shards = max(1, -(-held["docs"] // DOCS_TOGETHER))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks))
    pairs = asked.select("q", block.alias("block"), F.explode("terms").alias("term")).join(terms, "term")
    # where each term is asked, with its weight: one row for a term, whatever its postings are
    wanted = materialize(weights.join(pairs.groupBy("tid").agg(F.collect_set("block").alias("blocks")), "tid"), "weights")
    if only is not None:
        wanted = F.broadcast(wanted)  # of TERMS_SENT rows at most
    m = f"(100 - 50 + ((50 * n * {held['docs']}L) div {max(held['length'], 1)}L))"
    impact = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {m}))")
    lists = postings.join(wanted, "term").select("key", "doc_id", "tid", impact.alias("impact"), F.explode("blocks").alias("block")).filter("impact > 0")
    lists = lists.select("block", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.lit(1).alias("kind"), "key", "doc_id", "tid", "impact",
                         F.lit(None).cast("array<long>").alias("tids"))
    everywhere = pairs.groupBy("q", "block").agg(F.collect_list("tid").alias("tids")).select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(0).alias("kind"), F.col("q").alias("key"),
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(-1).cast("long").alias("tid"), F.lit(0).cast("long").alias("impact"), "tids")
    found = search_cells(everywhere.unionByName(lists), k)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", F.col("id").alias("item_id")), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
