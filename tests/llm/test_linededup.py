"""Line deduplication against a plain version."""

from __future__ import annotations

import hashlib
import string
from collections import Counter

from pyspark.sql import functions as F

from fieldbook.llm import common, linededup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def keyed(text):
    return [line.strip(" \t\n\x0b\x0c\r").translate(FOLD) for line in (text or "").split("\n")]


def plain(texts, least):
    held = Counter(k for t in texts for k in set(keyed(t)) if k)
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line, k in zip(lines, keyed(text)) if not k or held[k] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_against_plain(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], 10)))
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in linededup.line_dedup(docs).collect())
    assert got == want
    assert sum(r[2] for r in got) > 20


def test_unicode_blanks_and_all_lines_gone(spark):
    same = ["É x\n y", "é x", "all gone\nALL GONE ", " all gone", "\t\n \n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(same * 3)], "doc_id long, text string")
    got = sorted(tuple(r) for r in linededup.line_dedup(docs, min_docs=3).collect())
    assert got == sorted((k, *x) for k, x in enumerate(plain(same * 3, 3)))
    assert got[2][3] == hashlib.sha256(b"").hexdigest()


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(k, f"own {k}\nshared\nown\nshared") for k in range(5)], "doc_id long, text string")
    rows = {r.doc_id: (r.text, r.n_dropped, [tuple(x) for x in r.keep]) for r in linededup.with_kept_lines(docs, "doc_id", "text", 2, keep_first=True).collect()}
    assert rows[0] == ("own 0\nshared\nown", 1, [(0, 3)])
    assert rows[4] == ("own 4", 3, [(0, 1)])


def test_texts_are_made_of_their_bitmaps(spark, docs, monkeypatch):
    """Break the bitmaps: the texts must follow."""
    real = linededup.keep_bitmaps
    monkeypatch.setattr(linededup, "keep_bitmaps", lambda *a: real(*a).withColumn("keep", F.slice("keep", 1, 1)))
    for r in linededup.with_kept_lines(docs.select("doc_id", "text"), "doc_id", "text").filter("n_dropped > 0").collect():
        lines = {x.doc_id: x.text for x in docs.filter("text like '%shared%'").collect()}[r.doc_id].split("\n")
        assert len(r.keep) == 1 and r.text == "\n".join(lines[r.keep[0].start :][: r.keep[0].length])


def test_only_documents_that_may_lose_lines_move(spark, monkeypatch):
    rows = [(k, f"own {k}" + "\nshared" * (k < 20)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: t.split("\n")[0] for k, t in rows}
    for most in (1 << 28, 0):  # the least bit set holds few rows apart, and changes nothing
        monkeypatch.setattr(common, "MOST_BITS", most)
        assert {r.doc_id: r.text for r in linededup.with_kept_lines(docs, "doc_id", "text").collect()} == want
    bits, buckets = common.bit_set(spark.createDataFrame([(k, k * k) for k in range(5000)], "id long, th long"), ["id", "th"])
    assert buckets * 32768 >= 8 * 5000 or buckets == 1
    assert bits.selectExpr("sum(bitmap_count(_bits))").first()[0] > 4000 * (buckets > 1)


def test_empty_table(no_docs):
    assert linededup.line_dedup(no_docs).collect() == []
