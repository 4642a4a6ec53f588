"""Queries on tables that the given ones do not hold: ties, odd values, large groups."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldbook.plans import catalog


def test_having_does_not_hang_on_row_order(spark, tmp_path):
    tie = [0.04] * 495 + [0.06] * 505  # the mean is 0.0501, on the bound; added in this order doubles exceed it
    groups = {1: tie, 2: tie[::-1], 3: [0.06] * 551, 4: [0.06] * 550, 5: [0.05] * 600 + [float("nan")], 6: [None] * 600, 7: [1e12] * 600, 8: [None] * 400 + [0.06] * 200, 9: [0.0501] * 600, 10: [0.05011] * 600, 11: [float("inf")] * 600}
    rows = [(key, value) for key, values in groups.items() for value in values]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.QUERIES["ag08_having"](spark, str(tmp_path)).collect()}
    assert got == {(3, 551), (5, 601), (7, 600), (8, 600), (10, 600), (11, 600)}


def test_score_log_loss_is_not_clipped(spark, sf, tmp_path):
    """Rates of some 60 and 300, where the SQL holds, and of 900, where its probability is 0."""
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    sizes = spark.range(25).select(F.col("id").cast("int").alias("c_nationkey"), F.element_at(F.array(F.lit(6000), F.lit(30000), F.lit(90000)), (F.col("id") % 3 + 1).cast("int")).alias("n"))
    sizes.select("c_nationkey", F.explode(F.sequence(F.lit(1), "n"))).select("c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.k: r.log_loss for r in catalog.QUERIES["dm29_score_log_loss"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{tmp_path}/nation.parquet/*.parquet')")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet') WHERE c_nationkey % 3 < 2")
    want = dict(con.execute(catalog.SQL["dm29_score_log_loss"]).fetchall())
    assert set(got) == set(range(25)) and min(want.values()) > 50
    assert {k: v for k, v in got.items() if k % 3 < 2} == want
    for k in range(2, 25, 3):
        terms = [(k % 4, 0.5 + 900), (k % 3, 0.6 + (k % 7) / 5)]
        assert got[k] == pytest.approx(sum(rate - n * math.log(rate) + math.lgamma(n + 1) for n, rate in terms), abs=1e-7)
