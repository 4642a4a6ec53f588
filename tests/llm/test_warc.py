"""Chunked framing, segments, broken archives, and the round trip of pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldbook.llm import warc


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_chunk_extensions_trailers_and_faults():
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0A\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc0123456789"
    for broken in (b"", b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc", b"3\r\nabcXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def pages():
    draw = random.Random(2)
    long = "".join(draw.choice("abc é\r\n") for _ in range(40_000))
    texts = [None, "", "short", "short", "x" * 100, "x" * 100, "é" * 50, "é" * 50, "x" * 99, "x" * 99, long, long, long + "!", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9]
    rows = [(k, f"http://a/{k}\r\nX: y" if k % 3 else None, t) for k, t in enumerate(texts)]
    return rows + [rows[4], (None, None, "a page without an id " * 10), (50, "u", "a page without an id " * 10)]


def test_round_trip(spark, monkeypatch):
    rows = pages()
    for segment, chunk in ((warc.SEGMENT, warc.CHUNK), (64, 10)):
        if segment == 64:
            rows = [(i, u, t[:3000] if t else t) for i, u, t in rows]
        monkeypatch.setattr(warc, "SEGMENT", segment)
        monkeypatch.setattr(warc.write_archives, "__defaults__", (segment, chunk))
        first = {}
        for i, _, t in rows:
            if i is not None:
                first[t or ""] = min(i, first.get(t or "", i))
        want = []
        for i, _, t in rows:
            data = (t or "").encode()
            again = len(data) >= 100 and i != first[t or ""]
            want.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[t or ""] if again else -1))
        df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS first")
        got = [tuple(-1 if x is None else x for x in r) for r in warc.round_trip(df).collect()]
        assert sorted(got) == sorted(want)


def test_segments_are_verified(spark):
    def segments(rows):
        cols = "origin string, number int, total long, type string, page string, refers_to string, url string, digest string, block binary"
        return spark.createDataFrame(rows, cols)

    def row(origin, number, total, block, kind="continuation"):
        return (origin, number, total, "response" if number == 1 else kind, "p" if number == 1 else None, None, None, None, bytearray(block))

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 9, 5)
    a, b, c = http[:30], http[30:70], http[70:]
    good = [row("good", 3, len(http), c), row("good", 1, None, a), row("good", 2, None, b)]
    bad = [row("gap", 1, None, a), row("gap", 3, len(http), c), row("length", 1, None, a), row("length", 2, 9, b), row("orphan", 2, len(b), b), row("twice", 1, None, a), row("twice", 2, 99, b), row("twice", 2, 99, b)]
    got = {r.fault: r for r in warc.reassemble(segments(good + bad)).collect()}
    assert bytes(got[None].payload) == b"payload" * 9
    faults = sorted(r.fault for r in warc.reassemble(segments(good + bad)).collect() if r.fault)
    assert faults == ["no origin", "segment numbers", "segment numbers", "total length"]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archive_is_read_by_lengths(spark, tmp_path):
    html = "first\r\n\r\nWARC/1.1\r\n\r\n" * 3
    df = spark.createDataFrame([(1, "http://a", html)], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", "page_id", "url", F.col("html"))
    record = warc.reassemble(warc.read_segments(spark, f"file://{tmp_path}/w")).collect()
    assert len(record) == 1 and bytes(record[0].payload).decode() == html and record[0].url == "http://a"


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, block, **fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": f"<urn:{kind}:{len(block)}>", **fields, "Content_Length": len(block)}.items())
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    records = [record("warcinfo", b"software: x"), record("response", http, WARC_Payload_Digest=f"sha1:{sha1}", WARC_Target_URI="http://a/"), record("resource", b"hello", WARC_Payload_Digest=f"md5:{hashlib.md5(b'hello').hexdigest()}"), record("response", http + b"!", WARC_Payload_Digest=f"sha1:{sha1}")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:2]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[2:]))
    (tmp_path / "readme.md").write_text("no archive")
    found = warc.reassemble(warc.read_segments(spark, f"file://{tmp_path}")).collect()
    got = sorted((r.type, bytes(r.payload) if r.payload is not None else None, r.fault) for r in found)
    assert got == [("resource", b"hello", None), ("response", b"hello", None), ("response", b"hello!", "payload digest"), ("warcinfo", None, None)]
