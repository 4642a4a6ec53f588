"""Contamination, phrase and proximity matches against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from fieldbook.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    own, hit, found = words(text), set(), set()
    for i, item in items:
        w = words(item)
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(own) - n + 1 if windows else 0):
            if tuple(own[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(i))
    near = {str(i) for i, item in items if any(plain_near(own, window, decontam.SLOP) for window in plain_windows(item))}
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)


def plain_windows(item):
    w = words(item)
    n = min(10, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def plain_near(own, window, slop):
    """The shortest (start, span) at which the window's words come in order with few others."""
    found = set()
    for start in (k for k, w in enumerate(own) if w == window[0]):
        ends = {start}
        for word in window[1:]:
            ends = {k for e in ends for k in range(e + 1, min(len(own), start + len(window) + slop)) if own[k] == word}
        found |= {(start, min(ends) - start + 1)} if ends else set()
    return sorted((s, n) for s, n in found if not any((a, m) != (s, n) and a >= s and a + m <= s + n for a, m in found))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice(["the", "of", "Éa", "b2", "cc", "dd", "日本", "x"]) for _ in range(n))
    items = [(k, text(draw.choice([3, 9, 10, 11, 25]))) for k in range(30)] + [(99, None), (98, ""), (97, "!!"), (5, text(12)), (96, "rare"), (None, "no id")]
    rows = [(None, "rare"), (1, None), (2, ""), (2, "RARE rare, rare")]
    for k in range(3, 60):
        parts = [text(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            parts += [draw.choice(items)[1] or "", text(draw.randint(0, 9)).upper()]
        rows.append((k, draw.choice([" ", "-", "\n"]).join(parts)))
    rows.append((60, text(40_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, items, docs, spark.createDataFrame(items, "item_id long, text string")


def check(corpus):
    rows, items, docs, benchmark = corpus
    want = sorted((-1 if i is None else i, *plain(t, [x for x in items if x[0] is not None])) for i, t in rows)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in decontam.contamination(docs, benchmark).collect())
    assert got == want
    assert 5 < sum(r[5] for r in got) < len(got)


def test_against_plain(corpus):
    check(corpus)


def test_segments_slices_and_blocks_change_nothing(corpus, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(decontam, "_CANDIDATES", 7)
    check(corpus)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 3)
    check(corpus)


def test_stored_index_gives_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "c x b a"), (3, "a y y y y b c"), (4, "a b b c")], "id long, text string")
    index = decontam.build_index(docs, "id", "text")
    exact = decontam.matches(index, [("i", b"b c")]).collect()
    assert sorted(tuple(r) for r in exact) == [(1, "i", "phrase", 1, 2), (3, "i", "phrase", 5, 2), (4, "i", "phrase", 2, 2)]
    near = decontam.matches(index, [("i", b"a b c")], slop=1).collect()
    assert sorted(tuple(r) for r in near) == [(1, "i", "phrase", 0, 3), (4, "i", "proximity", 0, 4)]
    again = decontam.search(index, spark.createDataFrame([(7, "x b"), (8, "e")], "item_id long, text string")).filter("size(items) > 0").collect()
    assert sorted((r.id, r.n_words, r.hits, r["items"]) for r in again) == [(1, 5, [4, 5], ["8"]), (2, 4, [1, 3], ["7"])]


def test_an_index_holds_all_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c a")], "id long, text string").coalesce(1)
    row = decontam.build_index(docs, "id", "text").first()
    steps = np.frombuffer(row.positions, np.int32)
    lists = np.split(np.cumsum(steps), np.cumsum(row.n)[:-1])
    assert {bytes(t): x.tolist() for t, x in zip(row.terms, lists)} == {b"a": [0, 2, 4], b"b": [1], b"c": [3]}


@pytest.mark.parametrize("slop", [1, 2, 5])
def test_proximity_against_plain(spark, slop):
    draw = random.Random(slop)
    text = lambda n, names: " ".join(draw.choice(names) for _ in range(n))
    rows = [(k, text(draw.randint(0, 120), "aabbcdefgh")) for k in range(60)]
    items = [(str(k), text(draw.randint(1, 6), "aabcdefgh").encode()) for k in range(40)]
    index = decontam.build_index(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = sorted((r.id, r.item_id, r.start, r.span) for r in decontam.matches(index, items, slop).collect())
    want = sorted((k, i, s, n) for k, t in rows for i, item in items for s, n in plain_near(words(t), tuple(words(item.decode())), slop))
    assert got == want and len(want) > 300


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(no_docs, items).collect() == []
    got = decontam.contamination(docs, items).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)
