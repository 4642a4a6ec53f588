"""Probabilities and scores against known values and plain formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldbook.functions import probability as P
from fieldbook.functions import scoring as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_devig(spark):
    p, total = P.devig(F.lit(2.0), F.lit(4.0), F.lit(4.0))
    assert one(spark, *p, total) == (0.5, 0.25, 0.25, 1.0)
    for bad in (1.0, float("inf"), 0.5):
        with pytest.raises(PySparkException):
            one(spark, P.devig(F.lit(bad), F.lit(4.0), F.lit(4.0))[1])


def test_pool_ends(spark):
    p, q = [F.lit(x) for x in (0.5, 0.3, 0.2)], [F.lit(x) for x in (0.2, 0.2, 0.6)]
    assert one(spark, *P.log_pool(p, q, 0.0)) == pytest.approx((0.5, 0.3, 0.2))
    assert one(spark, *P.log_pool(p, q, 1.0)) == pytest.approx((0.2, 0.2, 0.6))


def test_grid_and_tail_add_up(spark):
    df = spark.createDataFrame([(1, 1.7, 0.9), (2, 4.0, 3.5)], "k int, h double, a double")
    for r in P.outcome_sums(P.score_grid(df, ["k"], F.col("h"), F.col("a")), ["k"]).collect():
        assert r.p_home + r.p_draw + r.p_away + r.omitted == pytest.approx(1)
        assert r.omitted >= 0


def test_gamma_poisson(spark):
    rows = spark.range(0, 60).select(P.gamma_poisson_pmf(F.col("id").cast("int"), F.lit(2.5), 4.0).alias("p"), "id").collect()
    assert sum(r.p for r in rows) == pytest.approx(1, abs=1e-9)
    assert sum(r.p * r.id for r in rows) == pytest.approx(2.5, abs=1e-7)


def test_log_loss_and_brier(spark):
    rows = spark.createDataFrame([("H", 0.5, 0.25, 0.25), ("D", 0.1, 0.7, 0.2)], "o string, h double, d double, a double")
    p = [F.col(c) for c in "hda"]
    seen = F.when(F.col("o") == "H", p[0]).when(F.col("o") == "D", p[1]).otherwise(p[2])
    got = rows.select(S.log_loss(seen).alias("l"), F.round(S.brier(p, [F.col("o") == x for x in "HDA"]), 9).alias("b")).collect()
    assert [r.l for r in got] == pytest.approx([-math.log(0.5), -math.log(0.7)])
    assert [r.b for r in got] == [0.375, 0.14]
    bins = S.calibration(rows, [], [(n, F.col(n), F.col("o") == n.upper()) for n in "hda"])
    assert bins.agg(F.sum("n")).first()[0] == 6


def test_last_bin_is_closed(spark):
    rows = spark.createDataFrame([(1.0, True), (0.95, False), (0.0, False)], "p double, o boolean")
    assert {r.bin for r in S.calibration(rows, [], [("x", F.col("p"), F.col("o"))]).collect()} == {0, 9}


def distribution(spark, actual):
    return spark.createDataFrame([("k", x, p, actual, 0.5) for x, p in ((0, 0.25), (2, 0.5), (4, 0.25))], "k string, x int, p double, y int, u double")


def test_crps_pit_and_coverage(spark):
    assert S.crps(distribution(spark, 2), ["k"], "x", "p", "y").first().crps == 0.25
    r = S.pit_and_coverage(distribution(spark, 2), ["k"], "x", "p", "y", "u", 0.9).first()
    assert (r.pit, r.covered, r.high - r.low) == (0.5, True, 4)
    assert S.pit_and_coverage(distribution(spark, -1), ["k"], "x", "p", "y", "u", 0.9).first().pit == 0
    assert S.pit_and_coverage(distribution(spark, 5), ["k"], "x", "p", "y", "u", 0.9).first().pit == 1


def test_crps_is_its_definition(spark):
    draw = np.random.default_rng(0)
    x, p = np.arange(8), draw.dirichlet(np.ones(8))
    rows = spark.createDataFrame([("k", int(a), float(b), 3) for a, b in zip(x, p)], "k string, x int, p double, y int")
    want = p @ abs(x - 3) - 0.5 * sum(p[i] * p[j] * abs(i - j) for i in x for j in x)
    assert S.crps(rows, ["k"], "x", "p", "y").first().crps == pytest.approx(want)


def test_rps(spark):
    def rps(forecast, seen):
        rows = [("k", r, f, o) for r, (f, o) in enumerate(zip(forecast, seen))]
        return S.rps(spark.createDataFrame(rows, "k string, r int, p double, o double"), ["k"], "r", "p", "o").first().rps

    assert rps([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]) == 0
    assert rps([1.0, 0.0, 0.0], [0.0, 0.0, 1.0]) == 1
    assert rps([0.5, 0.5], [0.0, 1.0]) == 0.25


def test_bootstrap_covers_and_repeats(spark):
    blocks = spark.createDataFrame([("a", k, float(k % 7), 2) for k in range(60)], "g string, block int, total double, n int")
    a = S.block_bootstrap(blocks, ["g"], "total", "n").first()
    assert a.low < a.estimate < a.high
    assert S.block_bootstrap(blocks.repartition(5), ["g"], "total", "n").first() == a
