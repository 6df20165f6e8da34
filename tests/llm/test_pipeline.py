"""The stages of the corpus pipeline, each against brute force on its own input."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from auditmill.llm import bpe
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "encoding"]
    for df in steps[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_quality_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(steps[1]))
    mine = {i: labels[i] for i in ids(steps[0]) if i in labels}
    good = [i for i, v in mine.items() if v == (1, 0)]
    bad = [i for i, v in mine.items() if v != (1, 0)]
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in bad]) < 0.3


def test_language_keeps_texts_with_letters(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    gone = set(before) - set(ids(steps[2]))
    assert len(gone) <= 0.02 * len(before)
    assert all(i not in ids(steps[2]) for i, t in before.items() if not any(c.isalpha() for c in t or ""))


def test_language_drops_letter_junk_and_keeps_every_language(spark, steps):
    """Random letters go, labelled clean documents of every language stay, short texts and rows of any kind are judged."""
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 10)))
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщыэюя"]
    junk = [(-1 - i, " ".join(word(alphabets[i % 3]) for _ in range(rng.choice([8, 30, 200]))), None, "s", 0) for i in range(300)]
    odd = [(-1000, None, "en", "s", 0), (-1001, "", "en", "s", 0), (-1002, "12 34", "en", "s", 0), (-1003, "the", None, "s", 3), (-1003, "the", None, "s", 3)]
    docs = steps[1].unionByName(spark.createDataFrame([*junk, *odd], steps[1].schema)).withColumn("lang_pred", F.lit("x")).withColumn("chars_read", F.lit("y"))
    got = corpus_pipeline.known_language(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    kept = ids(got)
    assert sum(-300 <= i < 0 for i in kept) <= 0.1 * len(junk)
    assert sorted(i for i in kept if i < -300) == [-1003, -1003]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [(r.doc_id, r.lang) for r in steps[1].collect() if labels.get(r.doc_id) == (1, 0)]
    for lang in {x for _, x in clean}:
        mine = [i for i, x in clean if x == lang]
        assert len(set(mine) & set(kept)) >= 0.98 * len(mine)
    assert corpus_pipeline.known_language(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_equal_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert sorted(ids(steps[3])) == sorted(i for i, _, _, kept in brute(rows, 5, 80) if kept)


def test_mixing_keeps_every_document(steps):
    before, after = ids(steps[3]), ids(steps[4])
    assert set(after) == set(before) and len(before) < len(after) <= 2 * len(before) + 1


def test_encoding_equals_the_library(steps):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    text = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert len(got) == steps[4].count()
    for r in got:
        tokens = np.array(oracle.encode_ordinary(text[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_mixing_uses_rows_that_share_an_id_once_each(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(1, "c d", None, "s", 3), (2, "e f", "en", "s", 3), (None, "g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixed(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


def test_near_copies_without_ids_go(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(4, base, "en", "s", 1), (None, base + " x", "en", "t", 1), (None, "only one of its kind and long", "en", "s", 1), (None, "only one of its kind and long", "de", "s", 1),
            (None, None, "en", "s", 0), (None, None, "en", "s", 0), (7, "", "en", "s", 0), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rep long")
    got = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), str(r.text)[:4]) for r in got.collect()) == [("4", "w0 w"), ("7", ""), ("None", "None"), ("None", "only")]
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), SF).count() == 0
