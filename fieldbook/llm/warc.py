"""WARC archives: writing, and reading back with segment reassembly.

A record is written whole, or in segments of at most ``SEGMENT`` bytes: the first carries
WARC-Segment-Number 1, continuation records carry the origin's id, their number and, the last
one, the total length (ISO 28500). Payloads are HTTP responses in chunked transfer framing.
Files are made by Spark's text sink, gzipped, with the record separator as its line end, so
they go wherever Spark can write, and are read as binary files of bounded size.

Reading groups the segments by origin id, orders them by number, and accepts a record only
if the numbers run from 1 without gap or repeat and the lengths add up to the stated total;
then the HTTP head is split off and the chunks are joined. A broken record is returned with
its fault and without payload, never dropped.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the least id is
the response; the others are revisits, which hold its id and digest and no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.common import cut, map_arrow, new_path

SEGMENT = 1 << 14
CHUNK = 1 << 12
REVISIT_BYTES = 100
FILE_ROWS = 2048
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[a : a + size]), payload[a : a + size]) for a in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The payload of chunked framing, with extensions and trailers; ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError("chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk length")
        parts.append(data[at : at + n])
        at += n + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _line(value: object) -> str:
    """A header value: no line may end inside it."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def records(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> list[bytes]:
    """The WARC records of one page, without their separators. ``key`` names the page in the record."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _line(url or "urn:none"))]
    about = [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-Id", key), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Page-Id", refers_to), *about]
        return [_head([*fields, ("Content-Length", len(http))]) + http]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *about]
    if len(parts) == 1:
        return [_head([*first, ("Content-Length", len(block))]) + block]
    out = [_head([*first, ("WARC-Segment-Number", 1), ("Content-Length", len(parts[0]))]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), *total]
        out.append(_head([*fields, ("Content-Length", len(part))]) + part)
    return out


def write_archives(pages: DataFrame, path: str, id_col: str, url_col: str, payload: Column, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """One response or revisit record per row, in gzipped files of at most ``FILE_ROWS`` records.

    Null ids have no page id in their records and are nobody's reference.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    firsts = rows.filter(large).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = cut(firsts, "repeated")
    joined = rows.join(firsts, "digest", "left")

    def run(batches):
        for batch in batches:
            out = []
            for k, url, digest, refers, body in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to", "payload"))):
                out += records("" if k is None else k, url, body, digest, refers, segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    made = map_arrow(joined.select(F.col("id").cast("string").alias("id"), "url", "digest", refers_to.cast("string").alias("refers_to"), "payload"), run, "value binary")
    # A string column of raw bytes: the text sink writes them as they are.
    made.select(F.col("value").cast("string")).write.option("lineSep", _END).option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


def _parse(data: memoryview):
    """(fields, block) of the records of one file, gzipped (in one member or many) or not;
    lengths alone say where records end."""
    at, whole = 0, bytes(data)
    if whole.startswith(b"\x1f\x8b"):
        whole = gzip.decompress(whole)
    while at < len(whole):
        end = whole.find(b"\r\n\r\n", at)
        if end < 0 or not whole.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in whole[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        at = end + 4
        size = int(fields["content-length"])
        if at + size > len(whole):
            raise ValueError(f"the record at byte {end} is cut off")
        yield fields, whole[at : at + size]
        at += size
        if whole[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no separator at byte {at}")
        at += 4


_SEGMENTS = "origin string, number int, total long, type string, page string, refers_to string, url string, digest string, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under the path: one row per record or segment.

    Archives are files named .warc or .warc.gz, or as the text sink names them (.txt, .txt.gz).
    ``digest`` is a stated SHA-256 in hexadecimal, or as it is stated, with its algorithm.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for f, block in _parse(batch.column(0)[k].as_buffer()):
                    rows.append((
                        f.get("warc-segment-origin-id") or f["warc-record-id"],
                        int(f["warc-segment-number"]) if "warc-segment-number" in f else None,
                        int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        f["warc-type"], f.get("warc-page-id") or None, f.get("warc-refers-to-page-id"), f.get("warc-target-uri"),
                        f.get("warc-payload-digest", "").removeprefix("sha256:") or None, block,
                    ))
                names = [x.split()[0] for x in _SEGMENTS.split(", ")]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path)
    return map_arrow(files.select("content"), run, _SEGMENTS)


_RECORDS = "page string, type string, refers_to string, url string, digest string, payload binary, payload_bytes long, payload_sha256 string, fault string"


def _agrees(stated: str, payload: bytes) -> bool:
    """Whether a stated digest is the payload's; of an unknown algorithm nothing can be said."""
    name, _, value = stated.rpartition(":")
    name = (name or "sha256").lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return True
    raw = hashlib.new(name, payload).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _record(f: dict, block: bytes | None, fault: str | None) -> tuple:
    payload = body = None
    if fault is None and f["type"] == "resource":
        payload = body = block
    if fault is None and f["type"] == "response":
        head, _, body = block.partition(b"\r\n\r\n")
        payload = body
        if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
            try:
                payload = dechunked(body)
            except ValueError as broken:
                payload, fault = None, str(broken)
    digest = hashlib.sha256(payload).hexdigest() if payload is not None else None
    # Some writers state the digest of the body as it was sent, in its chunks.
    if fault is None and payload is not None and f["digest"] and not (_agrees(f["digest"], payload) or _agrees(f["digest"], body)):
        fault = "payload digest"
    return f["page"], f["type"], f["refers_to"], f["url"], f["digest"], payload, None if payload is None else len(payload), digest, fault


def reassemble(segments: DataFrame) -> DataFrame:
    """The records of the segments, with their payloads, or the fault of those that are broken.

    Whole records stay where they are; segments meet by origin id and number, and stream.
    """
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows):
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def whole(batches):
        for batch in batches:
            yield batch_of([_record(f, f["block"], None) for f in batch.to_pylist()])

    def finish(parts: list[dict]) -> tuple:
        first = next((p for p in parts if p["type"] != "continuation"), None)
        numbers = [p["number"] for p in parts]
        total = [p["total"] for p in parts if p["total"] is not None]
        block = b"".join(p["block"] for p in parts)
        fault = None
        if first is None:
            fault = "no origin"
        elif numbers != list(range(1, len(parts) + 1)):
            fault = "segment numbers"
        elif total != [len(block)]:
            fault = "total length"
        return _record(first or parts[0], block, fault)

    def joined(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                if held and held[0]["origin"] != f["origin"]:
                    out.append(finish(held))
                    held = []
                held.append(f)
            yield batch_of(out)
        if held:
            yield batch_of([finish(held)])

    alone = map_arrow(segments.filter("number is null"), whole, _RECORDS)
    parts = segments.filter("number is not null").repartition("origin").sortWithinPartitions("origin", "number")
    return alone.unionByName(map_arrow(parts, joined, _RECORDS))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its
    archives. A revisit's payload is that of the response with its digest.

    A null html is an empty payload. A page with a null id is written and read; it refers
    to a page with an id if one has its payload, else it is a response. Rows that repeat an
    id and payload are all responses. Other columns are ignored; an empty table gives no rows.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, F.col(html_col).cast("string"))
    found = reassemble(read_segments(spark, path)).select("page", "type", "refers_to", "digest", "payload_bytes", "payload_sha256", "fault")
    found = cut(found, "records")
    if broken := found.filter("fault is not null").limit(1).collect():
        raise ValueError(f"record of page {broken[0]['page']}: {broken[0]['fault']}")
    responses = found.filter("type = 'response'").select(F.col("page").alias("refers_to"), F.col("payload_sha256").alias("_sha"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = found.filter("type = 'revisit'").select("page", "type", "refers_to", "digest")
    # Only responses that something refers to; ids may repeat, so the digest tells them apart.
    revisits = revisits.join(responses.filter("refers_to is not null"), ["refers_to"], "left").filter("digest = _sha or _sha is null")
    own = found.filter("type = 'response'").select("page", "payload_bytes", F.col("payload_sha256").alias("digest"), "type", F.lit(None).cast("string").alias("refers_to"))
    out = own.unionByName(revisits.select("page", F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("digest"), "type", "refers_to"))
    return out.select(
        F.col("page").cast(kind).alias(id_col),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""
