"""The league of the model queries holds every order, in competitions of a season's size."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.plans import catalog
from fieldbook.plans.engine_queries import BLOCK, _league

MODELS = ("dm17_attack_defence_fit", "dm18_daily_filter_states", "dm22_state_sampling", "dm23_season_simulation", "dm30_rolling_backtest")


def shop(spark, folder, orders):
    spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 24).alias("c_nationkey")).write.parquet(f"{folder}/customer.parquet")
    rows = spark.range(0, orders, 10).select(F.col("id").alias("o_orderkey"), F.pmod(F.xxhash64("id"), F.lit(60)).alias("o_custkey"))
    rows.write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_every_order_is_a_match(spark, tmp_path):
    folder = shop(spark, tmp_path, 3 * BLOCK)
    league = _league(spark, folder)
    sizes = {r[0]: r[1] for r in league.groupBy("competition").count().collect()}
    assert sum(sizes.values()) == 3 * BLOCK // 10
    assert sorted(sizes) == [f"{side}-{k}" for side in ("north", "south") for k in range(3)]
    assert max(sizes.values()) <= BLOCK // 10


def test_models_cover_every_competition(spark, tmp_path):
    folder = shop(spark, tmp_path, 3 * BLOCK)
    for name in MODELS:
        found = catalog.QUERIES[name](spark, folder)
        assert found.select("competition").distinct().count() == 6, name
