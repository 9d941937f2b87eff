"""Encoding against the tiktoken library, decoding by the round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import table

from chronofold.llm import bpe, queries
from chronofold.llm.kernels import buffers

TEXTS = [
    None, "", " ", "it's we've  I'LL 'd 're''s\n\n  x\t y 'sfoo '", "a" * 1000 + " " * 500 + "\n", "日本語のテキスト" * 40 + "ⅷ½x", "x'll", "'l", "'r", "'", "' s", "don't",
    " 's  's\t's", "  a　b", "é🙂🙂'm", "wxyz" * 300, "<|endoftext|>", "\x00\x1f\x7f", "don't", "x " * 30000,
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as lines:
        return bpe.Vocabulary.read(lines.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("a Z'stmdrevl\n\t é1²日_-🙂　"), max_size=20), max_size=5))
def test_pieces(texts):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    raw, offsets = buffers(__import__("pyarrow").array(texts, "string"))
    got = bpe.pieces(raw, offsets)
    want = [at + len(t[: m.start()].encode()) for at, t in zip(offsets, texts, strict=False) for m in regex.finditer(bpe.PATTERN, t)]
    assert got.tolist() == want


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 64])
def test_encode_and_decode(spark, monkeypatch, vocabulary, library, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    ids = [3, 3, None, *range(4, len(TEXTS) + 1)]
    docs = table(spark, TEXTS, ids)
    rows = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    got = sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in rows)
    assert got == sorted((repr(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ids, TEXTS, strict=True))
    assert bpe.encode(table(spark, []), vocabulary).count() == 0


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r[1:] for r in queries.op11_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_null_ids_decode_to_null(spark, vocabulary):
    rows = spark.createDataFrame([(1, [64, 65]), (2, None), (3, [])], "a long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(rows, vocabulary).orderBy("a").collect()] == [bytearray(b"".join(vocabulary.tokens.take(np.array([64, 65])).to_pylist())), None, bytearray()]


def test_other_lists_of_tokens_are_refused():
    one = {bytes([i]): i for i in range(256)}
    with pytest.raises(ValueError, match="byte pair"):
        bpe.Vocabulary(one | {b"abc": 256})
    with pytest.raises(ValueError, match="byte pair"):
        bpe.Vocabulary(one | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError, match="every byte"):
        bpe.Vocabulary({b"a": 0})
    assert bpe.Vocabulary(one | {b"ab": 256, b"abc": 257}).tokens[257].as_py() == b"abc"
