"""Tokens and round trips against the library itself."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldbook.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", " ", "  ", "\n", "'s", "'", "l", "1", "2", "!", "é", "日", "本", "<|endoftext|>", "<|", "th", "ing", "\x1c", "\x85", "　", "A", "՘", "꟎"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def small(vocabulary):
    return bpe.Encoder(vocabulary, leaf=16)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def joined(own, text, size):
    out, run = [], []
    for glued, kind, data in own.segments(text, size):
        if not glued:
            out, run = out + own.join_all(run), []
        run.append(own.segment(kind, data))
    return out + own.join_all(run)


def odd_texts(n):
    draw = random.Random(n)
    for _ in range(n):
        yield "".join(draw.choice(ALPHABET) * draw.choice([1, 1, 1, 2, 30]) for _ in range(draw.randint(0, 40)))


def test_pieces_and_segments_join_exactly(library, small):
    for text in odd_texts(400):
        want = ids(library, text)
        assert small.encode(text) == want
        assert small.decode(want) == library.decode(want, skip_special_tokens=False)
        for size in (5, 23):
            assert joined(small, text, size) == want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_any_text(library, small, text):
    assert small.encode(text) == ids(library, text)
    assert small.decode(small.encode(text)) == text


def test_long_unsplit_runs(library, small):
    draw = random.Random(0)
    for letters in ("abcdefthing", "a", "01", "!?-"):
        text = "".join(draw.choice(letters) for _ in range(30_000))
        assert small.encode(text) == ids(library, text)
        assert joined(small, text, 500) == ids(library, text)


def test_query_against_library(spark, docs, library, vocabulary):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd_texts(60))], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    want = []
    for i, text in both.collect():
        found = ids(library, text or "")
        want.append((-1 if i is None else i, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for size in (100, bpe.SEGMENT):
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe.token_digests(both, vocabulary, size=size).collect())
        assert got == sorted(want)


def test_encode_and_decode_tables(spark, docs, vocabulary, no_docs):
    rows = bpe.decode_ids(bpe.encode_texts(docs, vocabulary, size=300), vocabulary).collect()
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in docs.collect())
    assert bpe.token_digests(no_docs, vocabulary).collect() == []
