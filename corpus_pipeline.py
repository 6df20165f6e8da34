"""The corpus pipeline: documents in, token digests out.  Counts as part of the llm subpackage.

Every stage works on all that its predecessor kept, and all but the last return the columns of
``documents``.  Rows without a doc_id are judged like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditmill.llm import bpe, langid, minhash, mixing, quality
from auditmill.session import materialize, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # of the language


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what importance resampling against the accepted labels leaves out."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("selected").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those whose language stays open and those that read like none."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    told = langid.identify(docs.select(*COLUMNS), langid.train(docs.select("text", "lang"), path), path, fit=True)
    return langid.understood(materialize(told, "told")).filter(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates (five words, 0.8).

    A row without an id goes when another of its group stays; rows without words have no group.
    """
    first = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).filter("leads")
    row_id = F.coalesce("doc_id", minhash.stand_in(F.col("text")))
    rows = docs.select(*COLUMNS).withColumn("_row", row_id).join(first.select(F.col("row_id").alias("_row")).distinct(), "_row", "left_semi")
    wordless = F.col("doc_id").isNull() & (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "")
    return rows.filter(~wordless).dropDuplicates(["_row"]).select(*COLUMNS).unionByName(rows.filter(wordless).select(*COLUMNS).distinct())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources: every document at least once, small sources up to twice as often as large ones.

    How often a document is used is found without its text, which is joined once.  Rows without
    an id are used once.
    """
    rows, key = docs.filter("doc_id is not null"), "doc_id"
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # rows that share an id are told apart by all they hold; equal ones stand for each other
        key = "_same"
        rows = rows.withColumn(key, F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    used = mixing.mix(rows.select(*dict.fromkeys(["doc_id", "text", "source", key])), max_repetition=2.0)
    times = used.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("times"))
    once = rows if key == "doc_id" else rows.dropDuplicates([key])
    named = once.join(times, key).withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document as counts and digests."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


#: (name, function(spark, docs, sf_dir)); each result is written as Parquet and read again.
STAGES = [
    ("quality", good_documents),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL expresses neither the models nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
