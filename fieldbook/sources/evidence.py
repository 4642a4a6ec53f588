"""The evidence store: immutable Parquet batches that manifests make visible.

A batch is known by the hash of its request and rows; publishing it again changes nothing.
Manifests list the files of a batch, and only listed files are read. All files go through
the Hadoop file system of their path. Readers give cutoffs as times in UTC with a zone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators.relops import grain_violations, latest_per_key, newest_non_null
from fieldbook.sources import canonical, files


TABLES_AT_ONCE = 4
FEW_MANIFESTS = 32
FILE_ROWS = 4_000_000  # of a data file at most


def utc(value: str | datetime) -> datetime:
    time = datetime.fromisoformat(value) if isinstance(value, str) else value
    if time.tzinfo is None:
        raise ValueError("a time needs its zone")
    return time.astimezone(timezone.utc)


def _aligned(df: DataFrame, table: str, request: Mapping) -> DataFrame:
    """The rows in the table's schema: unknown columns raise, missing ones are null."""
    target = canonical.schema(table)
    if unknown := set(df.columns) - set(target.names):
        raise ValueError(f"unknown {table} columns: {sorted(unknown)}")
    common = {
        "provider": F.lit(request["provider"]),
        "retrieved_at": F.lit(utc(request["retrieved_at"])),
        "evidence_basis": F.lit(request["evidence_basis"]),
        "source_sha256": F.lit(request["source_sha256"]),
        "normalization_version": F.lit(request.get("normalization_version", 1)),
    }
    return df.select(*[(F.col(f.name) if f.name in df.columns else common.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target])


def _stage(spark: SparkSession, where: str, name: str, df: DataFrame) -> tuple[int, int, str]:
    """Write a table's rows once; (rows, rows that break its rules, a hash of the rows).

    Everything is counted while the rows are written. The hash does not depend on their order
    or partitions: it is of their number and of 128 bits of sums over their JSON forms.
    """
    part = [c for c in ("competition_id", "season_id") if c in df.columns] or canonical.KEYS[name][:1]
    # Ranges of competition and season in files of their own, sorted by key: their
    # statistics let a reader skip files, and the columns stay in them.
    spread = df.repartitionByRange(*part).sortWithinPartitions(*part, *canonical.KEYS[name])
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")).alias(f"sum_{k}") for k in (1, 2)]
    broken = F.count_if(F.expr(canonical.INVALID.get(name, "false"))).alias("broken")
    seen = Observation()
    watched = spread.observe(seen, F.count(F.lit(1)).alias("n"), broken, *sums)
    watched.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(where)
    got = seen.get
    identity = (got["n"], got["sum_1"], got["sum_2"])
    return got["n"], got["broken"], hashlib.sha256(repr(identity).encode()).hexdigest()


def _digests(spark: SparkSession, where: str) -> dict[str, str]:
    """SHA-256 of each data file below a folder, worked out in tasks; file names are the keys."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(where)
    return {r[0].rsplit("/", 1)[1]: r[1] for r in rows.select("path", F.sha2("content", 256)).collect()}


def publish(spark: SparkSession, root: str, request: Mapping, tables: Mapping[str, DataFrame]) -> dict:
    """Check and write one batch, and its manifest last. Returns the manifest.

    Rows are written once, to a staging folder, where they are counted, hashed and checked; a
    batch that is known or wrong is thrown away, another is moved to its place.
    """
    rows = {name: _aligned(df, name, request) for name, df in sorted(tables.items())}
    staging = f"{root}/staging/{uuid.uuid4().hex}"
    try:
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            staged = dict(zip(rows, pool.map(lambda name: _stage(spark, f"{staging}/{name}", name, rows[name]), rows)))
        identity = {"request": {k: str(v) for k, v in request.items()}, "tables": {n: h for n, (_, _, h) in staged.items()}}
        batch = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
        path = f"{root}/manifests/{batch}.json"
        if (known := files.read_text(spark, path)) is not None:
            return json.loads(known)
        if wrong := [name for name, (_, broken, _) in staged.items() if broken]:
            raise ValueError(f"rows that break their table's rules: {', '.join(wrong)}")
        full = [name for name, (n, _, _) in staged.items() if n]

        def checked(name: str) -> tuple[bool, dict[str, str]]:
            keys = spark.read.schema(canonical.schema(name)).parquet(f"{staging}/{name}").select(canonical.KEYS[name])
            return grain_violations(keys, canonical.KEYS[name]).isEmpty(), _digests(spark, f"{staging}/{name}")

        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            found = dict(zip(full, pool.map(checked, full)))
        if wrong := [name for name, (alone, _) in found.items() if not alone]:
            raise ValueError(f"several rows of one evidence key: {', '.join(wrong)}")
        listed = []
        for name in full:
            files.move(spark, f"{staging}/{name}", f"{root}/parquet/{name}/{batch}")
            listed += [{"table": name, "path": f"parquet/{name}/{batch}/{f}", "sha256": sha} for f, sha in sorted(found[name][1].items())]
        manifest = {"batch_id": batch, "request": identity["request"], "files": listed, "rows": {name: n for name, (n, _, _) in staged.items()}}
        files.write_once(spark, path, json.dumps(manifest, sort_keys=True))
        return manifest
    finally:
        files.remove(spark, staging)


def publish_all(spark: SparkSession, root: str, batches: Iterable[tuple[Mapping, Mapping[str, DataFrame]]]) -> list[dict]:
    """Publish several batches, some at once: they do not depend on each other."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return list(pool.map(lambda b: publish(spark, root, *b), batches))


def read_manifests(spark: SparkSession, place: str) -> list[dict]:
    """The manifests of a store; many are read in tasks."""
    names = files.listed(spark, f"{place}/manifests", ".json")
    if len(names) <= FEW_MANIFESTS:
        return [json.loads(files.read_text(spark, f)) for f in names]
    return [json.loads(r[0]) for r in spark.read.option("wholetext", True).text(names).collect()]


class Dataset:
    """What is visible at a cutoff: observations, and the current row of each evidence key.

    ``workspace`` adds a local root; its batches count only where the remote root has none
    of that id. ``tables`` names the tables wanted; the others are absent, not empty.
    """

    def __init__(self, spark: SparkSession, root: str | None, cutoff: str | datetime | None = None, workspace: str | None = None, tables: Iterable[str] | None = None, manifests: list[dict] | None = None):
        self.spark, self.cutoff = spark, utc(cutoff) if cutoff is not None else None
        self.manifests: dict[str, tuple[str, dict]] = {}
        for place in (root, workspace):
            if place is None:
                continue
            found = manifests if manifests is not None and place == root else read_manifests(spark, place)
            for m in found:
                if self.cutoff is None or m.get("covers_history") or utc(m["request"]["retrieved_at"]) <= self.cutoff:
                    self.manifests.setdefault(m["batch_id"], (place, m))
        self.tables = tuple(tables) if tables is not None else tuple(canonical.COLUMNS)

    def observations(self, table: str) -> DataFrame:
        """All rows of the listed files, by name, up to the cutoff."""
        if table not in self.tables:
            raise KeyError(table)
        schema = canonical.schema(table)
        paths = [f"{place}/{f['path']}" for place, m in self.manifests.values() for f in m["files"] if f["table"] == table]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows if self.cutoff is None else rows.filter(F.col("retrieved_at") <= F.lit(self.cutoff))

    def current(self, table: str) -> DataFrame:
        """The effective row per provider and key; for players the newest known value of each column."""
        rows = self.observations(table)
        if table == "players":
            named = [(F.col("birth_date").isNotNull()).alias("dated"), "retrieved_at", "source_sha256"]
            columns = [newest_non_null(c, *(named if c == "name" else named[1:])).alias(c) for c in rows.columns if c != "player_id"]
            return rows.groupBy("player_id").agg(*columns)
        order = [F.desc("retrieved_at"), F.desc("source_sha256"), F.desc_nulls_last("normalization_version")]
        return latest_per_key(rows, ["provider", *canonical.KEYS[table]], order)

    def register(self, prefix: str = "") -> None:
        """Temporary views of the current rows and the observations."""
        for table in self.tables:
            self.observations(table).createOrReplaceTempView(f"{prefix}{table}_observations")
            self.current(table).createOrReplaceTempView(f"{prefix}{table}")


class Frames(Dataset):
    """What is visible at a cutoff of rows that no store holds yet: {table: DataFrame}.

    The same readers work on them; columns that a frame lacks are null.
    """

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], cutoff: str | datetime | None = None):
        super().__init__(spark, None, cutoff)
        self.frames = {name: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in canonical.schema(name)]) for name, df in frames.items()}

    def observations(self, table: str) -> DataFrame:
        rows = self.frames.get(table)
        if rows is None:
            return super().observations(table)
        return rows if self.cutoff is None else rows.filter(F.col("retrieved_at") <= F.lit(self.cutoff))


def verify_files(spark: SparkSession, root: str, manifests: Iterable[dict]) -> list[str]:
    """The listed files that are missing or whose bytes have changed."""
    return [f["path"] for m in manifests for f in m["files"] if files.digest(spark, f"{root}/{f['path']}") != f["sha256"]]


def compact(spark: SparkSession, root: str, manifests: list[dict], tables: Iterable[str]) -> dict:
    """One base batch with the distinct rows of the listed batches; the files stay until the swap."""
    data = Dataset(spark, root, tables=tables, manifests=manifests)
    replaced = sorted(m["batch_id"] for m in manifests)
    batch = hashlib.sha256("\n".join(replaced).encode()).hexdigest()
    listed, counts = [], {}
    for name in data.tables:
        rows = data.observations(name).distinct()
        where = f"{root}/parquet/{name}/{batch}"
        rows.repartitionByRange(*canonical.KEYS[name]).sortWithinPartitions(*canonical.KEYS[name]).write.mode("overwrite").option("compression", "zstd").parquet(where)
        counts[name] = spark.read.schema(canonical.schema(name)).parquet(where).count()
        listed += [{"table": name, "path": f"parquet/{name}/{batch}/{f}", "sha256": sha} for f, sha in sorted(_digests(spark, where).items())]
    request = {"retrieved_at": max(m["request"]["retrieved_at"] for m in manifests)}
    return {"batch_id": batch, "covers_history": True, "replaces": replaced, "request": request, "files": listed, "rows": counts}


def replay(spark: SparkSession, root: str, captures: DataFrame, normalizers: Mapping[str, Callable[[DataFrame], Mapping[str, DataFrame]]]) -> list[dict]:
    """Publish all retained captures again, in order of time and hash.

    captures: kind, provider, retrieved_at (text with a zone), source_sha256, payload. Each
    kind's normaliser turns the payload column of its captures into canonical tables.
    """
    order = captures.select("kind", "provider", "retrieved_at", "source_sha256").distinct().orderBy("retrieved_at", "source_sha256")

    def batch(c) -> tuple[dict, Mapping[str, DataFrame]]:
        own = captures.filter((F.col("source_sha256") == c.source_sha256) & (F.col("retrieved_at") == c.retrieved_at) & (F.col("kind") == c.kind))
        request = {"provider": c.provider, "retrieved_at": c.retrieved_at, "evidence_basis": "replay", "source_sha256": c.source_sha256}
        return request, normalizers[c.kind](own.select("payload"))

    return publish_all(spark, root, [batch(c) for c in order.collect()])  # one row per capture, not per observation
