"""Byte-level BPE through sentencepiece against the tiktoken library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import bpe, tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.MULTI), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return bpe.byte_bpe(bpe.MULTI, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(reference, model, text):
    ids = model.encode(text).tolist()
    assert ids == reference.encode_ordinary(text)
    assert model.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["Wort", "don't", " ", "  ", "\n", "\t", "\r", "12", "3.5", "--", "_x", "É", "ß", "\xa0", "l'été", "'s", "²"]), max_size=12).map("".join))
def test_plain_text(reference, model, text):
    assert model.encode(text).tolist() == reference.encode_ordinary(text)


def test_every_token_and_kept_bound(reference, model, monkeypatch):
    """Each token that is text encodes to itself alone; with nothing kept the ids are the same."""
    for rank, data in model.bytes_of.items():
        text = data.decode(errors="ignore")
        if text.encode() == data:
            assert model.encode(text).tolist() == reference.encode_ordinary(text), rank
    monkeypatch.setattr(bpe, "KEPT", 0)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 0)
    bare = bpe.ByteBpe(bpe.read_ranks(bpe.MULTI), public_tokenizers.PATTERN)
    assert bare.encode("Hello there, großer Wörterberg 12345").tolist() == reference.encode_ordinary("Hello there, großer Wörterberg 12345")
    assert not bare.kept and not bare.pieces


def test_other_vocabulary(reference):
    name = "byte_bpe_50k.tiktoken"
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={})
    text = "It's 1,234 naïve façades\n\n  über 東京 🙂 <|endoftext|>"
    assert bpe.byte_bpe(name, public_tokenizers.PATTERN).encode(text).tolist() == other.encode_ordinary(text)


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.model_of({b"a": 0, b"b": 2})


def digest_of(ids, data):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def test_cases(spark, reference):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    texts = [None, "", " ", "a" * 200_000, "word " * 50_000, "▁under ▁ score", "\x00\x1c\u0085", "é́ 𝔘𝔫𝔦", "same", "same"]
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + ", ids int, data string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(bpe.decode(bpe.encode(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i if i else None] == digest_of(reference.encode_ordinary(t or ""), (t or "").encode())


def test_empty_table_and_null_ids(spark):
    assert bpe.digest(bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA)))).collect() == []
    only = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r)[1:] for r in bpe.digest(bpe.decode(only)).collect()} == {digest_of([], b"")}


def test_whole_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(bpe.decode(bpe.encode(docs))).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == digest_of(reference.encode_ordinary(r.text or ""), (r.text or "").encode())
