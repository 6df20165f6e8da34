"""The forward sum against all segmentations; accuracy on held-out texts; odd rows."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditmill.llm import langid, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def segmentations(word, known):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in known or len(p) == 1 for p in parts):
            yield [known.get(p, -1) for p in parts]


WORDS = ["▁a", "▁thinking", "▁b語ä", "▁", "▁zz", "▁the", "▁über"]


@pytest.fixture(scope="module")
def known():
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=PATH)
    texts = sorted({t for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for t in [model.id_to_piece(i)] if 0 < len(t) <= langid.LONGEST})
    return {t: i for i, t in enumerate(texts)}


def test_sums_over_all_segmentations(known):
    pieces = langid.lexicon(PATH)
    table = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 3).T
    got = langid.log_likelihoods(WORDS, pieces, table)
    counts = np.zeros((pieces.size, 2))
    weights = np.array([[i + 1, 2 * i] for i in range(len(WORDS))], float)
    for word, row, w in zip(WORDS, got, weights):
        ways = list(segmentations(word, known))
        assert np.allclose(row, np.log(sum(np.prod([table[k] for k in s], axis=0) for s in ways)))
        total = math.fsum(langid.START ** len(s) for s in ways)
        for s in ways:
            for k in s:
                counts[k] += langid.START ** len(s) / total * w
    assert np.allclose(langid.expected(WORDS, weights, pieces), counts)


def test_long_words_stay_finite():
    pieces = langid.lexicon(PATH)
    table = np.full((pieces.size, 2), 1e-15)
    words = langid.words_of("语" * 5000 + " " + "the" * 40)
    assert max(map(len, words)) <= langid.PART and "".join(words) == "▁" + "语" * 5000 + "▁" + "the" * 40
    assert np.isfinite(langid.log_likelihoods(words, pieces, table)).all()
    assert np.isfinite(langid.expected(words, np.ones((len(words), 1)), pieces)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [("the cat and the dog", "en", "x"), ("le chat et le chien", "fr", "x"), (None, "fr", None), ("", "en", "y"), ("123 !?", None, "z"), ("the", None, "z"), ("x" * 5000, None, "z")]
    df = spark.createDataFrame(rows, "text string, lang string, score string")
    model = langid.train(df, PATH)
    assert model[0] == ["en", "fr"]
    got = langid.identify(df, model, PATH).collect()
    assert [r.lang_pred for r in got][:6] == ["en", "fr", "und", "und", "und", "en"] and got[2].score == 0 and len(got) == 7
    none = langid.train(df.filter("false"), PATH)
    assert {r.lang_pred for r in langid.identify(df, none, PATH).collect()} == {"und"}
    assert langid.identify(df.limit(0), model, PATH).count() == 0


def test_words_are_computed_in_groups_of_bounded_size():
    words = pa.array([chr(0x4E00 + i % 5000) * 60 + str(i) for i in range(8000)] + ["语" * 500_000, "end"])
    back = {}
    for parts, owner in langid.parts_of(words):
        assert sum(map(len, parts)) <= langid.TOGETHER
        for part, i in zip(parts, owner.tolist(), strict=True):
            back[i] = back.get(i, "") + part
    assert [back[i] for i in range(len(words))] == ["▁" + w for w in words.to_pylist()]


def test_words_are_split_as_python_does():
    blanks = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    texts = [None, "", blanks, *(f"a{b} b a{b}" for b in blanks), "\u200ba\u2060b \ufeffc"]
    names, code, row = langid.distinct_words(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for c, r in zip(code.tolist(), row.tolist(), strict=True):
        got[r].append(names[c].as_py())
    assert got == [(t or "").split() for t in texts]


def test_texts_of_one_language_are_not_dealt_to_one_task(spark):
    """Most texts share a few languages: joined with the middles by language, they would be sorted in as many tasks."""
    rows = [(i, "aa", "aa", -100.0 if i % 10 else -900.0, 50) for i in range(80)] + [(80, None, "bb", -9000.0, 50), (81, None, langid.UNDETERMINED, 0.0, 0)]
    told = spark.createDataFrame(rows, "doc_id long, lang string, lang_pred string, log_likelihood double, chars_read long").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = langid.understood(told).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id for r in kept} == {i for i in range(81) if i % 10} | {80}
    assert len({r.task for r in kept if r.lang_pred == "aa"}) > 1
