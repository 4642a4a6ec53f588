"""Small files through the Hadoop file system that owns their path, and text sources.

Manifests and pointers are driver-side documents; data never passes through here.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The files below a folder that end so, sorted; none if there is no folder."""
    system, where = _open(spark, folder)
    if not system.exists(where):
        return []
    found, step = [], system.listFiles(where, True)
    while step.hasNext():
        found.append(step.next().getPath().toUri().toString())
    scheme = folder.partition(":")[0] if "://" in folder or folder.startswith("file:") else None
    plain = [f if scheme else f.removeprefix("file://").removeprefix("file:") for f in found]
    if scheme:
        plain = [folder.rstrip("/") + f[f.index(folder.partition("://")[2].rstrip("/")) + len(folder.partition("://")[2].rstrip("/")) :] if folder.partition("://")[2].rstrip("/") in f else f for f in plain]
    return sorted(f for f in plain if f.endswith(suffix))


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    system, where = _open(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    data = read_bytes(spark, path)
    return None if data is None else data.decode()


def digest(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file's bytes, read in the JVM."""
    system, where = _open(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; what an unfinished attempt left at the target goes first."""
    system, where = _open(spark, target)
    system.delete(where, True)
    system.mkdirs(where.getParent())
    if not system.rename(_open(spark, source)[1], where):
        raise OSError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    system, where = _open(spark, path)
    system.delete(where, True)


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file; the same bytes again are no-op, other bytes an error."""
    known = read_text(spark, path)
    if known is not None:
        if known != text:
            raise ValueError(f"{path} exists with other content")
        return
    _write(spark, path, text, False)


def _write(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    system, where = _open(spark, path)
    stream = system.create(where, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file, over one that is there."""
    _write(spark, path, text, True)


def update_pointer(spark: SparkSession, path: str, change: Callable[[dict], dict], attempts: int = 8) -> dict:
    """Change a small JSON document if nobody else has meanwhile: versions are files made once.

    Version n+1 is created, not overwritten, so of two writers one fails and tries again.
    """
    for _ in range(attempts):
        versions = listed(spark, path, ".json")
        now = json.loads(read_text(spark, versions[-1])) if versions else {}
        new = change(now)
        try:
            _write(spark, f"{path}/{len(versions):012d}.json", json.dumps(new, sort_keys=True), False)
            return new
        except Exception as conflict:  # the file exists: another writer was first
            if "already exists" not in str(conflict) and "FileAlreadyExists" not in str(conflict):
                raise
    raise RuntimeError(f"{path} changed {attempts} times meanwhile")


def read_pointer(spark: SparkSession, path: str) -> dict:
    versions = listed(spark, path, ".json")
    return json.loads(read_text(spark, versions[-1])) if versions else {}


def csv_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The rows of one provider CSV with source_row, from 2 on.

    UTF-8 with or without a mark, else cp1252; blank rows are skipped, a missing header or a
    cell beyond the header is an error. One such file is a page, read on the driver.
    """
    data = read_bytes(spark, path)
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252")
    reader = csv.reader(io.StringIO(text))
    header = [h.strip() for h in next(reader, [])]
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"the header lacks {missing}")
    rows = []
    for number, cells in enumerate(reader, 2):
        if not any(c.strip() for c in cells):
            continue
        if any(c.strip() for c in cells[len(header) :]):
            raise ValueError(f"row {number} has cells beyond the header")
        rows.append([*(cells + [None] * len(header))[: len(header)], number])
    names = [f"`{h}` string" for h in header if h]
    kept = [k for k, h in enumerate(header) if h]
    return spark.createDataFrame([[*[r[k] for k in kept], r[-1]] for r in rows], ", ".join([*names, "source_row int"]))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document, gzipped or not, in a declared schema; another shape fails."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def write_report(spark: SparkSession, path: str, rows: DataFrame, most: int = 100_000) -> None:
    """A report: one JSON document {"rows": [...]} of a summary, written once.

    Reports are summaries for readers; one of more than ``most`` rows raises.
    """
    lines = [r[0] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"a report of more than {most} rows")
    write_once(spark, path, '{"rows": [' + ", ".join(sorted(lines)) + "]}")


def write_csv(rows: list[dict], df_spark: SparkSession, path: str) -> None:
    """A CSV whose header is the union of the rows' keys in the order in which they appear."""
    header = list(dict.fromkeys(k for r in rows for k in r))
    schema = ", ".join(f"`{h}` string" for h in header)
    data = [[None if r.get(h) is None else str(r[h]) for h in header] for r in rows]
    df_spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").csv(path, header=True)
