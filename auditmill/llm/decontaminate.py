"""Benchmark passages in documents: a prefix-filtered set join of word shingles.  DataFrame functions only.

1. Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
   window), equal windows are one.  A window is the set of its placed shingles: pairs of an offset
   and ``width`` consecutive words.
2. One scan of the documents keeps the places whose shingle occurs in some window.  Words never
   leave their row: shingle hashes meet a broadcast block of benchmark shingles of at most
   ``TOGETHER`` rows, and what meets is compared as text.  A larger benchmark is taken in several
   blocks, each with a scan of its own, so no block grows with any table.
3. Shingles are ordered by rarity: the number of places over all documents.  A window of k shingles
   of which ``need`` must be there has to share one of its k - need + 1 rarest; only these are joined.
4. The place of the shared shingle fixes where the window would begin.  What begins before the first
   word or ends after the last is dropped by its position and length.
5. What is left is verified exactly: all placed shingles of the window are looked up at their places
   in the document and counted.

With ``percent`` 100 a window occurs where its words follow each other in the document.  Below,
a stretch of the window's length counts from that share of its shingles on.

A passage that a third of all documents hold makes rows in proportion to its occurrences, dealt by
document and place; no group of documents meets in one task.

Defined results: every row is a document of its own, also with a null or repeated id; a null or
empty text has no words; an item without words has no window; equal items are found together;
items without an id mark words but are not counted or named; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark shingles that are broadcast at once: hash, text of some words and number, tens of MB.
TOGETHER = 200_000


def words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased; empty for null."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def windows_of(items: DataFrame, window: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(wid, len, shingles of offset and text) of the different windows, and (wid, item_id)."""
    held = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    each = held.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))))
    each = each.select("item_id", F.slice("w", F.col("start"), F.lit(window)).alias("w")).withColumn("said", F.array_join("w", " "))
    named = materialize(each.groupBy("said").agg(F.first("w").alias("w"), F.collect_set("item_id").alias("items"))
                        .withColumn("wid", F.monotonically_increasing_id()), "windows")
    n = F.least(F.size("w"), F.lit(width))
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(
        i.alias("offset"), F.array_join(F.slice("w", i + 1, n), " ").alias("said")))
    return (named.select("wid", F.size("w").alias("len"), n.alias("width"), shingles.alias("shingles")),
            named.select("wid", F.explode("items").alias("item_id")))


def places(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, pos, sid): a row for each place that holds a benchmark shingle, and one with
    null ``sid`` for each document (``pos`` null).  ``shingles`` has sid, width, said."""
    numbers = shingles.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
    widths, blocks = sorted(numbers["widths"]) or [1], max(1, -(-numbers["n"] // TOGETHER))
    rows = docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id())
    if blocks > 1:
        rows = materialize(rows, "texts")  # every block must see the same keys
    cut = rows.select("key", "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    # place -1 stands for the document itself
    spread = cut.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)))
    spread = spread.withColumn("width", F.explode(F.array(*map(F.lit, widths)))) if len(widths) > 1 else spread.withColumn("width", F.lit(widths[0]))
    word = [F.get(F.col("w"), F.col("pos") + i) for i in range(widths[-1])]
    hashed = reduce(lambda rest, n: F.when(F.col("width") == n, F.xxhash64(*word[:n])).otherwise(rest), widths[:-1], F.xxhash64(*word))
    there = (F.col("pos") >= 0) & (F.col("pos") + F.col("width") <= F.col("n_words"))
    spread = spread.withColumn("h", F.when(there, hashed))
    side = shingles.select(F.xxhash64(*[F.get(F.split("said", " "), i) for i in range(widths[-1])]).alias("k"), "sid", "said")
    # Compared where hashes meet, inside the join: no row that leaves it carries the words.  Written
    # as a range, as an equality would become a key that is built for every place.
    said = F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ")
    same = (F.col("h") == F.col("k")) & (said <= F.col("said")) & (said >= F.col("said"))
    out = []
    for block in range(blocks):
        some = F.broadcast(side.filter(F.pmod("k", F.lit(blocks)) == block))
        met = spread.join(some, same, "left").select("key", "doc_id", "n_words", "pos", "width", "sid")
        itself = (F.col("pos") < 0) & (F.col("width") == widths[0]) if block == 0 else F.lit(False)
        out.append(met.filter(F.col("sid").isNotNull() | itself).drop("width"))
    return materialize(reduce(DataFrame.unionByName, out), "places")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, width: int = 5, percent: int = 100) -> tuple[DataFrame, DataFrame]:
    """Where windows of ``items(item_id, text)`` occur in ``docs(doc_id, text)``.

    First table: one row per document: key, doc_id, n_words, n_hit, item_ids (sorted as text),
    contaminated.  Second: one row per occurrence: key, doc_id, start (word, from 0), len, wid.
    """
    windows, owners = windows_of(items.select("item_id", "text"), window, width)
    each = windows.select("wid", "len", "width", F.size("shingles").alias("k"), F.explode("shingles").alias("s")).select(
        "wid", "len", "width", "k", "s.offset", "s.said")
    shingles = materialize(each.groupBy("said").agg(F.first("width").alias("width")).withColumn("sid", F.monotonically_increasing_id()), "shingles")
    found = places(docs, shingles)
    held = found.filter(F.col("sid").isNotNull())
    often = held.groupBy("sid").agg(F.count(F.lit(1)).alias("times"))
    placed = each.join(shingles.select("said", "sid"), "said").join(often, "sid", "left")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "sid", "offset")))
    need = F.ceil(F.col("k") * percent / 100)
    ordered = placed.groupBy("wid", "len", "k").agg(rare.alias("tokens")).withColumn("need", F.greatest(need, F.lit(1)))
    ordered = materialize(ordered, "prefixes")
    prefix = ordered.select("wid", "len", "need", "tokens", F.explode(F.slice("tokens", F.lit(1), (F.col("k") - F.col("need") + 1).cast("int"))).alias("t"))
    prefix = prefix.filter("t.times > 0").select("wid", "len", "need", "tokens", F.col("t.sid").alias("sid"), F.col("t.offset").alias("offset"))
    may = held.join(prefix, "sid").withColumn("start", F.col("pos") - F.col("offset"))
    may = may.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    if percent < 100:  # more than one rare shingle may lead to the same place
        may = may.dropDuplicates(["key", "start", "wid"])
    asked = may.select("key", "start", "wid", "len", "need", F.explode("tokens").alias("t")).select(
        "key", "start", "wid", "len", "need", (F.col("start") + F.col("t.offset")).alias("pos"), F.col("t.sid").alias("sid"))
    seen = asked.join(held.select("key", "doc_id", "pos", "sid"), ["key", "pos", "sid"]).groupBy("key", "start", "wid").agg(
        F.count(F.lit(1)).alias("n"), F.first("len").alias("len"), F.first("need").alias("need"), F.first("doc_id").alias("doc_id"))
    hits = materialize(seen.filter(F.col("n") >= F.col("need")).select("key", "doc_id", F.col("start").cast("long").alias("start"), "len", "wid"), "hits")

    before = Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = hits.groupBy("key", "start").agg(F.max("len").alias("len")).withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    fresh = F.greatest(end - F.greatest("start", "covered"), F.lit(0))
    hit = spans.groupBy("key").agg(F.sum(fresh).cast("long").alias("n_hit"))
    named = hits.select("key", "wid").distinct().join(owners, "wid").groupBy("key").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    told = hit.join(named, "key", "left")
    rows = found.filter(F.col("sid").isNull()).drop("pos", "sid").join(told, "key", "left").select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    return rows, hits


def digests(rows: DataFrame) -> DataFrame:
    """The items of every document as a number and a digest."""
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
