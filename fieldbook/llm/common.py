"""Tables in the shared folder, rows told apart by bit sets, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.session import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in a local session, as in tests, one is made and set; other
    sessions must name theirs, as executors do not see the driver's own folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
        atexit.register(remove, spark, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one that goes when this driver ends."""
    own = f"{shared_folder(spark)}/fieldbook-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_leave, system, where)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _leave(system, where) -> None:
    try:
        system.delete(where, True)
    except Exception:  # the JVM has gone first; the folder is scratch space
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table: what follows has no lineage before it.

    The table outlives lost executors. ``path`` on the result names it for ``drop``.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is scratch space
        pass


def drop(table: DataFrame | None) -> None:
    if table is not None and getattr(table, "path", None):
        remove(table.sparkSession, table.path)


def named(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(docs: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that ``docs`` has, so that none clashes."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def require_free(docs: DataFrame, added) -> None:
    if free(docs, *added) != list(added):
        raise ValueError(f"{', '.join(added)} are to be added, and one of them is there already: give other names")


#: Bits of a set of hashed rows at most (32 MB, so it may be broadcast), and those that one row of it holds.
MOST_BITS = 1 << 28
_BUCKET = 1 << 15


def bit_set(found: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(_bucket, _bits) of the hashed rows of ``found``, and the number of buckets.

    About eight bits a row, and ``MOST_BITS`` at most.
    """
    buckets = min(MOST_BITS, max(1, 8 * found.count())) // _BUCKET + 1
    position = F.pmod(_spread(columns), F.lit(buckets * _BUCKET))
    marked = found.groupBy(F.floor(position / _BUCKET).alias("_bucket"))
    return marked.agg(F.bitmap_construct_agg(F.pmod(position, F.lit(_BUCKET))).alias("_bits")), buckets


def _spread(columns: list[str]) -> Column:
    return F.xxhash64(*columns, F.lit("bit"))


def apart(rows: DataFrame, found: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that may be among ``found`` by these columns of both, and those that are not.

    Told by a hashed bit set, so that only the former, with some chance hits, need meet
    ``found`` in a shuffle. Where ``found`` is larger than the set is made for, more rows may
    be; none is ever lost. ``found`` should be a written table, as it is read twice.
    """
    marked, buckets = bit_set(found, columns)
    position, bucket, bits, may = free(rows, "position", "bucket", "bits", "may")
    placed = rows.withColumn(position, F.pmod(_spread(columns), F.lit(buckets * _BUCKET)))
    placed = placed.withColumn(bucket, F.floor(F.col(position) / _BUCKET)).join(F.broadcast(marked.toDF(bucket, bits)), bucket, "left")
    bit = F.pmod(position, F.lit(_BUCKET))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = placed.withColumn(may, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False)))
    kept = [named(c) for c in rows.columns]
    return placed.filter(F.col(may)).select(kept), placed.filter(~F.col(may)).select(kept)


BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES`` bytes, or one row if that is
    more. A worker holds few batches at a time, whatever the length of the texts."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(str(conf.get(_BATCHES, "67108864")).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCHES, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def slices(batch, column: int, most: int = 2 << 20):
    """An Arrow batch in parts whose values in one binary column take about ``most`` bytes."""
    import numpy as np

    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable.

    Alternates large stars and small stars (Kiveris et al. 2014): every step is a
    partially aggregated minimum and a join, rows stay linear in the edges, and a hub's
    rows can be split by adaptive execution because nothing above the join needs them
    together. Each round is cut by a written table, so lineage stays short. Edges may
    repeat, point either way and hold self-loops; an edge with a null end is no edge.
    """
    whole = edges.filter("a is not null and b is not null")
    pairs = whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(pairs.distinct(), "links")
    state = _state(now)
    while True:
        both = now.filter("a <> b")
        both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now.filter("a = b")).distinct()
        stars = cut(large, "links")
        drop(now)
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(stars)
        before, state = state, _state(now)
        if before == state:
            break
    stars = now.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = stars.union(roots)
    found.path = now.path
    return found
