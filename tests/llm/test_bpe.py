"""Encoding against tiktoken, decoding as an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from auditmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


ODD = ["", " ", "  ", "\n", "a", " a", "  a", "\t\ta", "\n's", "x's we're I'll you'd 'twas ''s 's's", "don' t", "'re'vex", " 's", "a b", "a   b",
       "12 345x6", "!!! ?a", "étude", "日本語 テキスト", "🙂🙂 a🙂", "a" * 3000, " " * 3000 + "x", "'" * 9 + "s", "x\r\n\r\n  y ", "ſ'ſ", "a'", "a'l", "a'r"]


def test_ids_equal_tiktoken(oracle):
    rng = random.Random(3)
    alphabet = list("ab1 2\n\t '!.?sdtmrevl") + ["é", "ß", "語", "🙂", " ", " ", "́", "٣", "Ⅷ"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    got = bpe.encode_texts(texts, PATH)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text), repr(text)


def test_every_code_point(oracle):
    text = "".join(f"{chr(c)}a {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(bpe.encode_texts([text], PATH)[0], "<u4").tolist() == oracle.encode_ordinary(text)


def test_windows_hand_the_state_on(monkeypatch, oracle):
    monkeypatch.setattr(bpe, "WINDOW", 5)
    for text in ODD + ["we're  here, they'll\n\n see 123's"]:
        assert np.frombuffer(bpe.encode_texts([text], PATH)[0], "<u4").tolist() == oracle.encode_ordinary(text)
        ids = np.array(oracle.encode_ordinary(text), np.uint32)
        ends = np.cumsum([len(oracle.decode_single_token_bytes(i)) for i in ids]).astype(np.uint32)
        assert bpe.decode_ids(ids, ends, PATH) == text.encode()


def test_columns_and_nulls(spark, oracle):
    rows = [(1, None, "k", 5), (2, "", None, 6), (3, "Hello, world's end", "k", 7), (3, "Hello, world's end", "k", 7), (None, "x" * 50_000, "z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digests(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        ids = np.array(oracle.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(df.limit(0), PATH).count() == 0
    apart = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in apart) == sorted(x[1] or "" for x in rows)


def test_rank_file_is_read_whole():
    with open(PATH, "rb") as lines:
        assert len(bpe.ranks(PATH)) == sum(1 for x in lines if base64.b64decode(x.split()[0]))
