from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import bpe

FILE = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(str(public_tokenizers.path(FILE)))
CASES = [
    "", " ", "a ", " a", "  \n\n x", "a" * 5000, "éè" * 600, "it's we'll 'LL 's", "a<|endoftext|>b <|endoftext|>", "\x1c\x85​",
    "日本語テキスト123", "🙂👨‍👩‍👧", "\U00010940abc", "x　 y 　z", "-" * 700, "a  b\t c \n", "١٢٣ ½ ²", "\x00\x01",
]


def agree(text: str) -> None:
    codec = bpe.codec(FILE)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases_agree_with_the_library(text):
    agree(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_agrees_with_the_library(text):
    agree(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab éè'\n.1~", max_size=60))
def test_dense_texts_agree_with_the_library(text):
    agree(text)


def test_cuts_are_certain():
    codec = bpe.codec(FILE)
    for raw in ("zqxjéè".encode(), b"the", bytes(range(128, 160))):
        parts = codec.cuts(raw)
        assert b"".join(parts) == raw
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1:] + b[:1] in token for token in codec.tokens[:50256])


def test_caches_turn_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    codec = bpe.Codec(str(public_tokenizers.path(FILE)))
    text = " ".join(f"word{i} x{i % 7}" for i in range(200))
    assert codec.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows_and_columns(spark):
    rows = [(1, "two words", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (5, "a" * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, FILE).collect()
    assert len(got) == 5 and bpe.encode(docs, FILE).columns == ["doc_id", "text", "n_tokens", "ids"]
    assert [r["n_tokens"] for r in got[:4]] == [2, 0, 0, 0]
    assert got[4]["ids"] == LIBRARY.encode("a" * 200_000, add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), FILE).count() == 0


def test_digests(spark):
    got = bpe.digests(spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string"), FILE).collect()
    ids = LIBRARY.encode("the cat", add_special_tokens=False).ids
    assert tuple(got[0]) == (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"the cat").hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[1]) == (2, 0, empty, empty)
