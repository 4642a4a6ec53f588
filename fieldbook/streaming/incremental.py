"""Structured Streaming forms of incremental ingest and windowed counts.

Each micro-batch is folded into a written table under its batch number, so a batch that
runs twice replaces itself: the result is that of running it once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators.relops import latest_per_key
from fieldbook.sources import files


def read_events(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


BUCKETS = 16
_MAP = "_buckets.json"  # readers of data files skip this name


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder; none if there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def run_current_view(stream: DataFrame, keys: Sequence[str], order: Sequence[Column], root: str) -> DataFrame:
    """The current row per key after all available input, kept up batch by batch.

    The view is kept in ``BUCKETS`` buckets of the keys' hash. A batch is folded into the
    buckets that it touches and written as a new version of these alone, with a list of the
    newest version of every bucket, written last. A batch that runs twice replaces its own.
    Run again without new input, it gives the view as it is.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def versions(below: int) -> dict[str, int]:
        """The version of each bucket after the last finished batch before one."""
        for n in sorted((int(x) for x in _names(spark, f"{root}/view") if x.isdigit() and int(x) < below), reverse=True):
            if (text := files.read_text(spark, f"{root}/view/{n}/{_MAP}")) is not None:
                return json.loads(text)
        return {}

    def current(schema, known: dict[str, int]) -> DataFrame | None:
        paths = [f"{root}/view/{n}/bucket={b}" for b, n in sorted(known.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def fold(batch: DataFrame, number: int) -> None:
        now, known = latest_per_key(batch, keys, order), versions(number)
        before = current(batch.schema, known)
        if before is not None:
            touched = F.broadcast(now.select(bucket.alias("_b")).distinct())  # BUCKETS rows at most
            now = latest_per_key(before.withColumn("_b", bucket).join(touched, "_b", "left_semi").select(*batch.columns).unionByName(now), keys, order)
        now.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/view/{number}")
        written = [x.removeprefix("bucket=") for x in _names(spark, f"{root}/view/{number}") if x.startswith("bucket=")]
        files.write_text(spark, f"{root}/view/{number}/{_MAP}", json.dumps(known | {b: number for b in written}))

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = current(stream.schema, versions((_last_batch(spark, root) or 0) + 1))
    return found if found is not None else spark.createDataFrame([], stream.schema)


def _last_batch(spark: SparkSession, root: str) -> int | None:
    """The number of the last batch that the checkpoint has committed."""
    return max((int(x) for x in _names(spark, f"{root}/checkpoint/commits") if x.isdigit()), default=None)


def run_window_counts(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str], root: str) -> DataFrame:
    """Counts per tumbling window and key. Rows later than the watermark allows are dropped,
    and a window's state goes once the watermark has passed it.

    Each batch writes the counts that it changed; a window's newest are its counts. Times
    without zone are given one: a watermark needs it.
    """
    spark = stream.sparkSession
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/counts/batch-{number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if _last_batch(spark, root) is None:
        return spark.createDataFrame([], counts.schema)
    written = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{root}/counts/*")
    return latest_per_key(written, ["start", *keys], [F.desc("batch")]).drop("batch")


def refresh_action(before: dict[str, str], now: dict[str, str]) -> str:
    """What a change of the four identities asks for: the strongest action that any needs."""
    changed = {k for k in now if before.get(k) != now[k]}
    if changed & {"fit", "projection"}:
        return "full"
    if {"market", "display"} <= changed:
        return "market_display"
    return "market" if "market" in changed else "display" if "display" in changed else "idle"
