"""Probability operators on match outcomes and scores, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def devig(*odds: Column) -> tuple[list[Column], Column]:
    """(probabilities, overround) of decimal odds; odds of at most 1 or not finite raise."""
    checked = [F.when((o > 1) & (o < float("inf")), 1 / o).otherwise(F.raise_error(F.lit("odds must be above 1 and finite")).cast("double")) for o in odds]
    total = sum(checked[1:], checked[0])
    return [c / total for c in checked], total


def log_pool(p: Sequence[Column], q: Sequence[Column], weight: float) -> list[Column]:
    """The logarithmic pool of two distributions, shifted by its maximum."""
    logs = [(1 - weight) * F.log(a) + weight * F.log(b) for a, b in zip(p, q)]
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    total = sum(parts[1:], parts[0])
    return [x / total for x in parts]


def poisson_log_pmf(k: Column, rate: Column) -> Column:
    """log P(K = k), for k up to 20; finite where the probability is too small for a double."""
    return k * F.log(rate) - rate - F.log(F.factorial(k.cast("int")).cast("double"))


def poisson_pmf(k: Column, rate: Column) -> Column:
    """P(K = k), for k up to 20."""
    return F.exp(poisson_log_pmf(k, rate))


def shifted_rates(home: Column, away: Column, shift: Column) -> tuple[Column, Column]:
    """Log rates moved by +shift and -shift."""
    return home * F.exp(shift), away * F.exp(-shift)


def score_grid(df: DataFrame, keys: Sequence[str], home: Column, away: Column, most: int = 10) -> DataFrame:
    """(keys, home_goals, away_goals, probability, log_probability): independent Poisson scores up to ``most`` goals.

    The two marginals are exploded once each; a key's cells are (most+1)^2 by definition.
    """
    goals = F.sequence(F.lit(0), F.lit(most))
    rows = df.select(*keys, home.alias("_h"), away.alias("_a")).select("*", F.explode(goals).alias("home_goals")).select("*", F.explode(goals).alias("away_goals"))
    sides = (F.col("home_goals"), F.col("_h")), (F.col("away_goals"), F.col("_a"))
    (p, q), (log_p, log_q) = [poisson_pmf(*s) for s in sides], [poisson_log_pmf(*s) for s in sides]
    return rows.select(*keys, "home_goals", "away_goals", (p * q).alias("probability"), (log_p + log_q).alias("log_probability"))


def outcome_sums(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p_home, p_draw, p_away, omitted) of a score grid; omitted is the mass outside it."""
    h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("probability")
    return grid.groupBy(*keys).agg(
        F.sum(F.when(h > a, p).otherwise(0.0)).alias("p_home"),
        F.sum(F.when(h == a, p).otherwise(0.0)).alias("p_draw"),
        F.sum(F.when(h < a, p).otherwise(0.0)).alias("p_away"),
        F.greatest(F.lit(0.0), 1 - F.sum(p)).alias("omitted"),
    )


def poisson_mixture(home_log: Column, away_log: Column, home_sd: Column, away_sd: Column, order: int = 9) -> list[tuple[float, Column, Column]]:
    """(weight, home rate, away rate): Gauss-Hermite nodes of independent normal log rates."""
    import numpy as np

    nodes, weights = np.polynomial.hermite_e.hermegauss(order)
    weights = weights / weights.sum()
    return [(float(u * v), F.exp(home_log + home_sd * float(x)), F.exp(away_log + away_sd * float(y))) for x, u in zip(nodes, weights) for y, v in zip(nodes, weights)]


def gamma_poisson_pmf(k: Column, mean: Column, shape: float) -> Column:
    """P(K = k) of a Poisson count whose rate is gamma with this mean and shape."""
    terms = F.transform(F.sequence(F.lit(0), k), lambda i: F.when(i < k, F.log((i + shape) / (i + 1.0))).otherwise(0.0))
    choose = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    return F.exp(choose + shape * F.log(shape / (shape + mean)) + k * F.log(mean / (shape + mean)))
