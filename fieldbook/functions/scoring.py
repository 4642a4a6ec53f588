"""Proper scores and calibration of probability forecasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-15


def log_loss(probability: Column) -> Column:
    """Minus the log of the observed class's probability, clipped away from 0 and 1."""
    return -F.log(F.greatest(F.least(probability, F.lit(1 - CLIP)), F.lit(CLIP)))


def brier(probabilities: Sequence[Column], observed: Sequence[Column]) -> Column:
    """The sum of squared errors over all classes."""
    parts = [(p - o.cast("double")) * (p - o.cast("double")) for p, o in zip(probabilities, observed)]
    return sum(parts[1:], parts[0])


def calibration(df: DataFrame, keys: Sequence[str], classes: Sequence[tuple[str, Column, Column]], bins: int = 10) -> DataFrame:
    """(keys, class, bin, n, forecast, observed): equal bins, the last one closed."""
    rows = F.array(*[F.struct(F.lit(name).alias("class"), p.alias("p"), o.cast("double").alias("o")) for name, p, o in classes])
    flat = df.select(*keys, F.inline(rows))
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return flat.groupBy(*keys, "class", at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("forecast"), F.avg("o").alias("observed"))


def classwise_ece(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ece): the mean over classes of their bins' weighted gaps."""
    gap = F.sum(F.col("n") * F.abs(F.col("forecast") - F.col("observed"))) / F.sum("n")
    return bins.groupBy(*keys, "class").agg(gap.alias("gap")).groupBy(*keys).agg(F.avg("gap").alias("ece"))


def with_cdf(df: DataFrame, keys: Sequence[str], value: str, p: str) -> DataFrame:
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cdf", F.sum(p).over(running))


def crps(df: DataFrame, keys: Sequence[str], value: str, p: str, actual: str) -> DataFrame:
    """(keys, crps) of a discrete distribution, a row per value, against its actual value."""
    rows = with_cdf(df, keys, value, p)
    spread = F.sum(F.col(p) * F.col(value) * (2 * F.col("cdf") - F.col(p) - 1))
    return rows.groupBy(*keys).agg((F.sum(F.col(p) * F.abs(F.col(value) - F.col(actual))) - spread).alias("crps"))


def rps(df: DataFrame, keys: Sequence[str], rank: str, p: str, observed: str) -> DataFrame:
    """(keys, rps): the mean squared gap of the cumulative distributions over all but the last rank."""
    order = Window.partitionBy(*keys).orderBy(rank)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(rank).over(Window.partitionBy(*keys))
    gaps = df.withColumn("gap", F.sum(p).over(running) - F.sum(observed).over(running)).withColumn("last", last).filter(F.col(rank) < F.col("last"))
    return gaps.groupBy(*keys).agg(F.avg(F.col("gap") * F.col("gap")).alias("rps"))


def pit_and_coverage(df: DataFrame, keys: Sequence[str], value: str, p: str, actual: str, uniform: str, level: float) -> DataFrame:
    """(keys, pit, low, high, covered): randomized PIT and the central interval at a level."""
    rows, tail = with_cdf(df, keys, value, p), (1 - level) / 2
    below = F.sum(F.when(F.col(value) < F.col(actual), F.col(p)).otherwise(0.0))
    at = F.sum(F.when(F.col(value) == F.col(actual), F.col(p)).otherwise(0.0))
    out = rows.groupBy(*keys).agg(
        (below + F.max(uniform) * at).alias("pit"),
        F.min(F.when(F.col("cdf") >= tail - 1e-12, F.col(value))).alias("low"),
        F.min(F.when(F.col("cdf") >= 1 - tail - 1e-12, F.col(value))).alias("high"),
        F.max(actual).alias("actual"),
    )
    return out.withColumn("covered", F.col("actual").between(F.col("low"), F.col("high")))


def block_bootstrap(blocks: DataFrame, keys: Sequence[str], total: str, n: str, samples: int = 200, seed: int = 7) -> DataFrame:
    """(keys, estimate, low, high) of a ratio of sums, resampling whole blocks with replacement.

    Each sample draws as many blocks as there are, from a hash of sample and draw, so the
    result does not depend on partitions; equal blocks are interchangeable. Blocks are rows
    of the calendar (weeks, seasons): a key has a bounded number of them.
    """
    order = Window.partitionBy(*keys).orderBy(total, n)
    numbered = blocks.select(*keys, F.row_number().over(order).cast("long").alias("_block"), F.col(total).alias("_total"), F.col(n).alias("_n"))
    draws = blocks.groupBy(*keys).agg(F.count("*").alias("_blocks")).withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    draws = draws.withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), "_blocks")))
    draws = draws.withColumn("_block", F.pmod(F.xxhash64("_sample", "_draw", F.lit(seed)), "_blocks") + 1)
    sampled = draws.join(numbered, [*keys, "_block"]).groupBy(*keys, "_sample").agg((F.sum("_total") / F.nullif(F.sum("_n"), F.lit(0))).alias("ratio"))
    ends = sampled.groupBy(*keys).agg(F.expr("percentile(ratio, 0.025)").alias("low"), F.expr("percentile(ratio, 0.975)").alias("high"))
    return blocks.groupBy(*keys).agg((F.sum(total) / F.sum(n)).alias("estimate")).join(ends, list(keys))


def least_mean_loss(rows: DataFrame, loss: Callable[[float], Column], steps: Sequence[float] = (0.05, 0.005, 0.001)) -> tuple[float, float, bool]:
    """(weight, mean loss, interior) of the weight from 0 to 1 at which a convex mean loss is least.

    Each step is one scan: the losses of a grid of weights are sums of the same pass, and the
    next, finer grid lies around the best one. Both ends are compared with what is between.
    """
    low, high, best = 0.0, 1.0, (0.0, 0.0)
    for step in steps:
        weights = [round(low + k * step, 9) for k in range(round((high - low) / step) + 1)]
        found = rows.agg(*[F.avg(loss(w)) for w in weights]).first()
        best = min(zip(found, weights))
        low, high = max(0.0, best[1] - step), min(1.0, best[1] + step)
    return best[1], best[0], 0 < best[1] < 1
