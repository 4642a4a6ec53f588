"""Reusable relational operators on DataFrames; all of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.session import scratch


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order.

    One shuffle on the keys. Spark's window-group limit keeps only the first row per
    key and map task, so a hot key does not travel as a whole.
    """
    return first_per_key(df, keys, order, 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter(F.col("_row") <= n).drop("_row")


def newest_non_null(column: str | Column, *order: str | Column) -> Column:
    """Aggregate: the value of the greatest order among rows where the value is not null."""
    value = F.col(column) if isinstance(column, str) else column
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))


def as_of_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, payload: Mapping[str, str], strict: bool = True, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every left row with the payload of the last right row of its key before it.

    Both sides are unioned and swept once per key, so no row meets all rows of its key.
    ``strict`` leaves out right rows at the very time. Ties go to the greatest payload.

    A key that holds much of the data is spread with ``bucket``, a rising function of the
    time such as its day: sweeps stay within a bucket, and what a bucket inherits comes from
    a table of one row per key and bucket.
    """
    mark = F.struct(F.col(right_time).alias("_at"), *[F.col(c).alias(new) for c, new in payload.items()])
    side = F.lit(1 if strict else -1)
    marks = right.select(F.col(key), F.col(right_time).alias("_time"), side.alias("_side"), mark.alias("_mark"))
    rows = left.withColumn("_time", F.col(left_time)).withColumn("_side", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    part = [key]
    if bucket is not None:
        both, part = both.withColumn("_bucket", bucket(F.col("_time"))), [key, "_bucket"]
    sweep = Window.partitionBy(*part).orderBy("_time", "_side", F.col("_mark").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(sweep)).filter("_side = 0")
    if bucket is not None:
        ends = both.groupBy(*part).agg(F.max("_mark").alias("_end"))
        before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        inherited = ends.select(*part, F.last("_end", ignorenulls=True).over(before).alias("_before"))
        seen = seen.join(inherited, part, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return seen.select(*left.columns, *[F.col(f"_last.{new}").alias(new) for new in payload.values()])


def global_row_number(df: DataFrame, order: Sequence[Column], name: str, path: str) -> DataFrame:
    """``df`` with its place in one total order, from 1, without a task that sees all rows.

    Rows are range-partitioned and sorted; only the tasks' counts are added up. ``path`` is a
    new folder for the sorted rows, which must be the same when they are read again.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread.write.parquet(path)
    placed = df.sparkSession.read.schema(spread.schema).parquet(path)
    task = F.shiftright("_at", 33)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row per task.
    found = placed.withColumn("_task", task).join(F.broadcast(offsets), "_task")
    return found.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def snapshot_left_join(rows: DataFrame, scope: Sequence[str], capture: Sequence[str], order: Sequence[Column], content: DataFrame, on: Sequence[str]) -> DataFrame:
    """The latest capture of each scope, left joined to the content of exactly that capture.

    A capture without content gives one row with null content: that nothing was there is evidence.
    """
    latest = latest_per_key(rows.select(*scope, *capture), scope, order)
    return latest.join(content, list(on), "left")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], agree: Sequence[str] = ()) -> DataFrame:
    """The rows of both sides for each key that both have, in one row.

    A key that a side has twice raises, and so do columns named in ``agree`` that differ: two
    predictions of one match must not be compared over different results.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
        return df.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"), F.first(row).alias(f"_{name}"))

    both = one(left, "left").join(one(right, "right"), list(keys))
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in keys])
    differ = F.lit(False)
    for c in agree:
        differ = differ | ~F.col("_left")[c].eqNullSafe(F.col("_right")[c])
    sound = F.when((F.col("_n_left") > 1) | (F.col("_n_right") > 1), F.raise_error(F.concat(F.lit("several rows of "), key)).cast("boolean"))
    sound = sound.when(differ, F.raise_error(F.concat(F.lit("the sides of a pair disagree: "), key)).cast("boolean")).otherwise(F.lit(True))
    checked = both.filter(sound)
    others = [c for c in right.columns if c not in keys and c not in agree]
    return checked.select(*keys, *[F.col("_left")[c].alias(c) for c in left.columns if c not in keys], *[F.col("_right")[c].alias(c) for c in others])


def in_scope(df: DataFrame, column: str, scope: str | Iterable[str], current: DataFrame | None = None) -> DataFrame:
    """The rows of a scope of versions: ``all``, ``none``, ``current`` (the versions of that
    table's column), or those that are named; a name that no row has raises."""
    if scope == "all":
        return df
    if scope == "none":
        return df.filter(F.lit(False))
    if scope == "current":
        if current is None:
            raise ValueError("which versions are current?")
        return df.join(current.select(column).distinct(), column, "left_semi").select(df.columns)
    if isinstance(scope, str):
        raise ValueError(f"no scope {scope!r}: name versions in a list")
    names = sorted(set(scope))
    found = {r[0] for r in df.filter(F.col(column).isin(names)).select(column).distinct().collect()}
    if missing := set(names) - found:
        raise ValueError(f"unknown versions: {', '.join(sorted(missing))}")
    return df.filter(F.col(column).isin(names))


def grain_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that several rows share, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def pivot_stages(df: DataFrame, keys: Sequence[str], stage: str, value: str, stages: Sequence[str]) -> DataFrame:
    """One column per stage: its greatest value, or null."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(stage) == s, F.col(value))).alias(s) for s in stages])


def two_sided(df: DataFrame, shared: Sequence[str], home: Mapping[str, str], away: Mapping[str, str]) -> DataFrame:
    """Each match as two rows, from either team's side, in one pass without a union."""
    sides = [F.struct(F.lit(name).alias("venue"), *[F.col(c).alias(new) for new, c in columns.items()]) for name, columns in (("home", home), ("away", away))]
    return df.select(*shared, F.inline(F.array(*sides)))


def digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell two multisets of rows apart, whatever their order.

    The number of rows and two sums of 60-bit parts of their SHA-256: every row counts, and
    exact decimals, as text, do not depend on the order of addition. Nulls differ from any text, and
    each value's length is part of the line, so that no two rows read alike.
    """
    value = [F.col(c).cast("string") for c in columns]
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~")) for v in value]), 256)
    part = lambda at: F.sum(F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(19,0)")).cast("string")
    return [F.count("*").alias("n"), part(1).alias("sum_a"), part(16).alias("sum_b")]


def lineage(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth): each node's last ancestor, by pointer doubling.

    The number of joins grows with the logarithm of the longest chain; each round is a table
    in the shared folder. A cycle has no root and raises; roots are their own.
    """
    now = edges.select(F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("at"), F.when(F.col(parent).isNull() | (F.col(parent) == F.col(node)), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(64):
        step = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        ahead = now.join(step, "at", "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))
        path = scratch(ahead.sparkSession, "lineage")
        ahead.write.parquet(path)
        ahead = ahead.sparkSession.read.schema(ahead.schema).parquet(path)
        now = ahead.drop("moved")
        if ahead.filter("moved").isEmpty():
            return now.select("node", F.col("at").alias("root"), "depth")
    raise ValueError("the lineage has a cycle")
