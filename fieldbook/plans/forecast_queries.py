"""Queries of the probability, scoring, table, impact and publication operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldbook.functions import probability as P
from fieldbook.functions import scoring as S
from fieldbook.operators import tables as T
from fieldbook.plans.registry import query
from fieldbook.session import load

RATES = "WITH r AS (SELECT c_nationkey AS k, 0.5 + count(*) / 100.0 AS lh, 0.6 + (c_nationkey % 7) / 5.0 AS la FROM customer GROUP BY c_nationkey)"


def _rates(spark, sf):
    counts = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return counts.select("k", (F.lit(0.5) + F.col("n") / F.lit(100.0)).alias("lh"), (F.lit(0.6) + (F.col("k") % 7) / F.lit(5.0)).alias("la"))


ODDS = """WITH o AS (SELECT p_partkey, 1 / (1 + p_size / 10.0) AS a, 1 / (1 + p_retailprice / 500) AS b, 1 / CAST(2.5 AS DOUBLE) AS c FROM part),
  q AS (SELECT p_partkey, a + b + c AS total, a / (a + b + c) AS pa, b / (a + b + c) AS pb, c / (a + b + c) AS pc FROM o)"""


def _odds(spark, sf):
    odds = [1 + F.col("p_size") / F.lit(10.0), 1 + F.col("p_retailprice") / F.lit(500.0), F.lit(2.5)]
    probabilities, total = P.devig(*odds)
    return load(spark, sf, "part").select("p_partkey", *[p.alias(n) for p, n in zip(probabilities, ("pa", "pb", "pc"))], total.alias("total"))


@query("dm05_devig", ODDS + " SELECT p_partkey, round(pa, 9) AS pa, round(pb, 9) AS pb, round(pc, 9) AS pc, round(total, 9) AS overround FROM q")
def dm05(spark, sf):
    return _odds(spark, sf).select("p_partkey", *[F.round(c, 9).alias(c) for c in ("pa", "pb", "pc")], F.round("total", 9).alias("overround"))


@query(
    "dm06_log_pool",
    ODDS + """, w AS (SELECT p_partkey, pow(CAST(0.5 AS DOUBLE), 0.7) * pow(pa, 0.3) AS x, pow(CAST(0.3 AS DOUBLE), 0.7) * pow(pb, 0.3) AS y, pow(CAST(0.2 AS DOUBLE), 0.7) * pow(pc, 0.3) AS z FROM q)
    SELECT p_partkey, round(x / (x + y + z), 8) AS ma, round(y / (x + y + z), 8) AS mb, round(z / (x + y + z), 8) AS mc FROM w""",
)
def dm06(spark, sf):
    pooled = P.log_pool([F.lit(0.5), F.lit(0.3), F.lit(0.2)], [F.col(c) for c in ("pa", "pb", "pc")], 0.3)
    return _odds(spark, sf).select("p_partkey", *[F.round(x, 8).alias(n) for x, n in zip(pooled, ("ma", "mb", "mc"))])


@query(
    "dm07_pool_weight",
    ODDS + """, g AS (SELECT CAST(w AS DOUBLE) / 20 AS w FROM range(0, 21) t(w)),
    l AS (SELECT w, avg(-ln(CASE p_partkey % 3 WHEN 0 THEN pow(0.5::DOUBLE, 1 - w) * pow(pa, w) WHEN 1 THEN pow(0.3::DOUBLE, 1 - w) * pow(pb, w) ELSE pow(0.2::DOUBLE, 1 - w) * pow(pc, w) END
      / (pow(0.5::DOUBLE, 1 - w) * pow(pa, w) + pow(0.3::DOUBLE, 1 - w) * pow(pb, w) + pow(0.2::DOUBLE, 1 - w) * pow(pc, w)))) AS loss FROM q, g GROUP BY w)
    SELECT round(w, 2) AS weight, round(loss, 7) AS loss FROM l""",
)
def dm07(spark, sf):
    # One pass: the losses of all weights of the grid are sums of the same scan.
    rows, outcome, model = _odds(spark, sf), F.col("p_partkey") % 3, [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    losses = []
    for k in range(21):
        a, b, c = P.log_pool(model, [F.col(x) for x in ("pa", "pb", "pc")], k / 20)
        losses.append(F.struct(F.lit(k / 20).alias("weight"), F.round(F.avg(S.log_loss(F.when(outcome == 0, a).when(outcome == 1, b).otherwise(c))), 7).alias("loss")))
    return rows.agg(F.array(*losses).alias("all")).select(F.inline("all"))


@query(
    "dm07_best_pool_weight",
    ODDS + """, g AS (SELECT CAST(w AS DOUBLE) / 1000 AS w FROM range(0, 1001) t(w)),
    l AS (SELECT w, avg(-ln(CASE p_partkey % 3 WHEN 0 THEN pow(0.05::DOUBLE, 1 - w) * pow(pa, w) WHEN 1 THEN pow(0.55::DOUBLE, 1 - w) * pow(pb, w) ELSE pow(0.4::DOUBLE, 1 - w) * pow(pc, w) END
      / (pow(0.05::DOUBLE, 1 - w) * pow(pa, w) + pow(0.55::DOUBLE, 1 - w) * pow(pb, w) + pow(0.4::DOUBLE, 1 - w) * pow(pc, w)))) AS loss FROM q, g GROUP BY w)
    SELECT round(arg_min(w, loss), 3) AS weight, round(min(loss), 7) AS loss, arg_min(w, loss) > 0 AND arg_min(w, loss) < 1 AS interior FROM l""",
)
def dm07b(spark, sf):
    rows, outcome, model = _odds(spark, sf), F.col("p_partkey") % 3, [F.lit(0.05), F.lit(0.55), F.lit(0.4)]

    def loss(weight: float):
        a, b, c = P.log_pool(model, [F.col(x) for x in ("pa", "pb", "pc")], weight)
        return S.log_loss(F.when(outcome == 0, a).when(outcome == 1, b).otherwise(c))

    weight, least, interior = S.least_mean_loss(rows, loss)
    return spark.createDataFrame([(weight, round(least, 7), interior)], "weight double, loss double, interior boolean")


@query(
    "dm08_market_stage",
    ODDS + """ SELECT q.p_partkey, coalesce(pa, 0.5) IS NOT NULL AS ok, CASE WHEN q.p_partkey % 3 = 0 THEN 'market_assisted' ELSE 'unadjusted' END AS stage,
    round(CASE WHEN q.p_partkey % 3 = 0 THEN pa ELSE 0.5 END, 8) AS p_home FROM q""",
)
def dm08(spark, sf):
    quotes = _odds(spark, sf).filter("p_partkey % 3 = 0").select("p_partkey", F.col("pa").alias("quoted"))
    rows = load(spark, sf, "part").select("p_partkey").join(quotes, "p_partkey", "left")
    stage = F.when(F.col("quoted").isNotNull(), "market_assisted").otherwise("unadjusted")
    return rows.select("p_partkey", F.lit(True).alias("ok"), stage.alias("stage"), F.round(F.coalesce("quoted", F.lit(0.5)), 8).alias("p_home"))


GRID = RATES + """, c AS (SELECT k, i AS h, j AS a, exp(i * ln(CAST(lh AS DOUBLE)) - lh) / factorial(i::INT) * exp(j * ln(CAST(la AS DOUBLE)) - la) / factorial(j::INT) AS p FROM r, range(0, 11) t(i), range(0, 11) u(j))"""


@query(
    "dm09_poisson_grid",
    GRID + """ SELECT k, round(sum(CASE WHEN h > a THEN p ELSE 0 END), 8) AS p_home, round(sum(CASE WHEN h = a THEN p ELSE 0 END), 8) AS p_draw,
    round(sum(CASE WHEN h < a THEN p ELSE 0 END), 8) AS p_away, round(greatest(0, 1 - sum(p)), 8) AS omitted FROM c GROUP BY k""",
)
def dm09(spark, sf):
    sums = P.outcome_sums(P.score_grid(_rates(spark, sf), ["k"], F.col("lh"), F.col("la")), ["k"])
    return sums.select("k", *[F.round(c, 8).alias(c) for c in ("p_home", "p_draw", "p_away", "omitted")])


@query(
    "dm10_gauss_hermite_mixture",
    RATES + """ SELECT k, round(CAST(lh AS DOUBLE) * exp(0.5 * 0.04), 6) AS mean_home, round(CAST(la AS DOUBLE) * exp(0.5 * 0.09), 6) AS mean_away FROM r""",
)
def dm10(spark, sf):
    nodes = P.poisson_mixture(F.log("lh"), F.log("la"), F.lit(0.2), F.lit(0.3))
    home, away = sum(w * h for w, h, _ in nodes), sum(w * a for w, _, a in nodes)
    return _rates(spark, sf).select("k", F.round(home, 6).alias("mean_home"), F.round(away, 6).alias("mean_away"))


@query("dm13_log_rate_shift", RATES + " SELECT k, round(lh * exp(0.1 * (k % 5 - 2)), 9) AS home_rate, round(la * exp(-0.1 * (k % 5 - 2)), 9) AS away_rate FROM r")
def dm13(spark, sf):
    home, away = P.shifted_rates(F.col("lh"), F.col("la"), F.lit(0.1) * (F.col("k") % 5 - 2))
    return _rates(spark, sf).select("k", F.round(home, 9).alias("home_rate"), F.round(away, 9).alias("away_rate"))


@query(
    "dm14_score_diagnostics",
    GRID + """ SELECT k, round(sum(CASE WHEN h + a >= 6 THEN p ELSE 0 END), 8) AS six, round(sum(CASE WHEN h = 0 AND a = 0 THEN p ELSE 0 END), 8) AS nil, round(sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0 END), 8) AS both_score,
    round(sum(h * p), 7) AS mean_home FROM c GROUP BY k""",
)
def dm14(spark, sf):
    grid = P.score_grid(_rates(spark, sf), ["k"], F.col("lh"), F.col("la"))
    h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("probability")
    where = lambda c: F.sum(F.when(c, p).otherwise(0.0))
    return grid.groupBy("k").agg(F.round(where(h + a >= 6), 8).alias("six"), F.round(where((h == 0) & (a == 0)), 8).alias("nil"), F.round(where((h > 0) & (a > 0)), 8).alias("both_score"), F.round(F.sum(h * p), 7).alias("mean_home"))


@query(
    "dm15_staged_probabilities",
    ODDS + """ SELECT p_partkey, 'unadjusted' AS stage, 0 AS stage_order, CAST(NULL AS VARCHAR) AS parent, round(CAST(0.5 AS DOUBLE), 8) AS p_home, true AS score_generating FROM q
    UNION ALL SELECT p_partkey, 'personnel_adjusted', 1, 'unadjusted', round(CAST(0.5 + (p_partkey % 5) / 100.0 AS DOUBLE), 8), true FROM q
    UNION ALL SELECT p_partkey, 'market_assisted', 2, 'personnel_adjusted', round(pa, 8), false FROM q WHERE p_partkey % 2 = 0""",
)
def dm15(spark, sf):
    def stage(name, order, parent, p, scores, when=F.lit(True)):
        row = F.struct(F.lit(name).alias("stage"), F.lit(order).alias("stage_order"), F.lit(parent).cast("string").alias("parent"), F.round(p, 8).alias("p_home"), F.lit(scores).alias("score_generating"))
        return F.when(when, row)

    stages = F.array_compact(F.array(
        stage("unadjusted", 0, None, F.lit(0.5), True),
        stage("personnel_adjusted", 1, "unadjusted", F.lit(0.5) + (F.col("p_partkey") % 5) / F.lit(100.0), True),
        stage("market_assisted", 2, "personnel_adjusted", F.col("pa"), False, F.col("p_partkey") % 2 == 0),
    ))
    return _odds(spark, sf).select("p_partkey", F.inline(stages))


@query(
    "dm20_evidence_weights",
    """WITH e AS (SELECT o_custkey % 50 AS g, o_orderpriority AS m, -ln(1 + count(*)) AS s FROM orders GROUP BY ALL), t AS (SELECT *, max(s) OVER (PARTITION BY g) AS top FROM e)
       SELECT g, m, round(exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY g), 9) AS weight FROM t""",
)
def dm20(spark, sf):
    evidence = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("m")).agg((-F.log(F.lit(1) + F.count("*"))).alias("s"))
    group = Window.partitionBy("g")
    shifted = evidence.withColumn("x", F.exp(F.col("s") - F.max("s").over(group)))
    return shifted.select("g", "m", F.round(F.col("x") / F.sum("x").over(group), 9).alias("weight"))


SHARES = """WITH n AS (SELECT user_id % 20 AS g, event_type AS t, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT g, t, n / sum(n) OVER (PARTITION BY g) AS p FROM n),
  w AS (SELECT g, max(p) FILTER (t = 'click') AS pc, max(p) FILTER (t = 'view') AS pv, 1 - max(p) FILTER (t = 'click') - max(p) FILTER (t = 'view') AS po FROM s GROUP BY g),
  e AS (SELECT event_id, user_id % 20 AS g, event_type AS t FROM events)"""


def _shares(spark, sf):
    events = load(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("g"), F.col("event_type").alias("t"))
    shares = events.groupBy("g").agg((F.count_if(F.col("t") == "click") / F.count("*")).alias("pc"), (F.count_if(F.col("t") == "view") / F.count("*")).alias("pv"))
    # One row per group of 20: small by construction.
    rows = events.join(F.broadcast(shares), "g").withColumn("po", 1 - F.col("pc") - F.col("pv"))
    t = F.col("t")
    return rows.withColumn("oc", t == "click").withColumn("ov", t == "view").withColumn("oo", ~t.isin("click", "view"))


@query(
    "dm29_log_loss_brier",
    SHARES + """ SELECT g, count(*) AS n, round(avg(-ln(CASE t WHEN 'click' THEN pc WHEN 'view' THEN pv ELSE po END)), 8) AS log_loss,
    round(avg(pow(pc - (t = 'click')::INT, 2) + pow(pv - (t = 'view')::INT, 2) + pow(po - (t NOT IN ('click', 'view'))::INT, 2)), 8) AS brier FROM e JOIN w USING (g) GROUP BY g""",
)
def dm29(spark, sf):
    rows = _shares(spark, sf)
    p = [F.col(c) for c in ("pc", "pv", "po")]
    observed = F.when(F.col("oc"), p[0]).when(F.col("ov"), p[1]).otherwise(p[2])
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg(S.log_loss(observed)), 8).alias("log_loss"), F.round(F.avg(S.brier(p, [F.col(c) for c in ("oc", "ov", "oo")])), 8).alias("brier"))


@query(
    "dm36_calibration_bins",
    SHARES + """, f AS (SELECT 'c' AS class, pc AS p, (t = 'click')::INT AS o FROM e JOIN w USING (g) UNION ALL SELECT 'v', pv, (t = 'view')::INT FROM e JOIN w USING (g) UNION ALL SELECT 'o', po, (t NOT IN ('click', 'view'))::INT FROM e JOIN w USING (g))
    SELECT class, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(p), 8) AS forecast, round(avg(o), 8) AS observed FROM f GROUP BY ALL""",
)
def dm36b(spark, sf):
    bins = S.calibration(_shares(spark, sf), [], [("c", F.col("pc"), F.col("oc")), ("v", F.col("pv"), F.col("ov")), ("o", F.col("po"), F.col("oo"))])
    return bins.select("class", "bin", "n", F.round("forecast", 8).alias("forecast"), F.round("observed", 8).alias("observed"))


@query(
    "dm29_score_log_loss",
    GRID + """, y AS (SELECT n_nationkey AS k, n_nationkey % 4 AS h, n_nationkey % 3 AS a FROM nation) SELECT k, round(-ln(p), 7) AS log_loss FROM c JOIN y USING (k, h, a)""",
)
def dm29c(spark, sf):
    """The loss of the score that came out, from the score grid: unlike an outcome's it is not
    clipped, and from log probabilities it is finite where the SQL's probability falls to 0.
    """
    scores = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 4).alias("home_goals"), (F.col("n_nationkey") % 3).alias("away_goals"))
    grid = P.score_grid(_rates(spark, sf), ["k"], F.col("lh"), F.col("la"))
    return grid.join(scores, ["k", "home_goals", "away_goals"]).select("k", F.round(-F.col("log_probability"), 7).alias("log_loss"))


@query(
    "dm29_classwise_ece",
    SHARES + """, f AS (SELECT 'c' AS class, pc AS p, (t = 'click')::INT AS o FROM e JOIN w USING (g) UNION ALL SELECT 'v', pv, (t = 'view')::INT FROM e JOIN w USING (g) UNION ALL SELECT 'o', po, (t NOT IN ('click', 'view'))::INT FROM e JOIN w USING (g)),
    b AS (SELECT class, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS f, avg(o) AS o FROM f GROUP BY ALL) SELECT round(avg(gap), 8) AS ece FROM (SELECT class, sum(n * abs(f - o)) / sum(n) AS gap FROM b GROUP BY class)""",
)
def dm29b(spark, sf):
    rows = _shares(spark, sf)
    bins = S.calibration(rows, [], [("c", F.col("pc"), F.col("oc")), ("v", F.col("pv"), F.col("ov")), ("o", F.col("po"), F.col("oo"))])
    return S.classwise_ece(bins, []).select(F.round("ece", 8).alias("ece"))


@query(
    "dm31_block_sums",
    """SELECT block, count(*) AS n, round(sum(delta), 6) AS total FROM (SELECT CAST(floor(datediff('day', DATE '1992-07-01', CAST(o_orderdate AS DATE)) / 28.0) AS BIGINT) AS block,
         ln(1 + o_totalprice) - ln(1 + o_custkey) AS delta FROM orders) GROUP BY block""",
)
def dm31(spark, sf):
    block = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1992-07-01").cast("date")) / F.lit(28.0))
    rows = load(spark, sf, "orders").select(block.alias("block"), (F.log1p("o_totalprice") - F.log1p("o_custkey")).alias("delta"))
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("delta"), 6).alias("total"))


BLOCK_SUMS = """WITH b AS (SELECT count(*) AS n, round(sum(delta), 6) AS total FROM (SELECT CAST(floor(datediff('day', DATE '1992-07-01', CAST(o_orderdate AS DATE)) / 28.0) AS BIGINT) AS block,
  ln(1 + o_totalprice) - ln(1 + o_custkey) AS delta FROM orders) GROUP BY block)"""


def _interval(rows):
    """The estimate, and that its interval holds it: what does not depend on the draws."""
    holds = (F.col("low") <= F.col("estimate")) & (F.col("estimate") <= F.col("high")) & (F.col("low") < F.col("high"))
    return rows.select("scope", F.round("estimate", 6).alias("estimate"), holds.alias("interval_holds"))


@query("dm31_block_bootstrap", BLOCK_SUMS + " SELECT 'all' AS scope, round(sum(total) / sum(n), 6) AS estimate, true AS interval_holds FROM b")
def dm31b(spark, sf):
    return _interval(S.block_bootstrap(dm31(spark, sf).withColumn("scope", F.lit("all")), ["scope"], "total", "n"))


@query(
    "dm32_rps",
    """WITH c AS (SELECT c_nationkey AS g, o_orderpriority AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
       s AS (SELECT g, r, n / sum(n) OVER (PARTITION BY g) AS p, CASE WHEN r = '2-HIGH' THEN 1.0 ELSE 0.0 END AS o FROM c),
       k AS (SELECT g, r, sum(p) OVER w - sum(o) OVER w AS gap, max(r) OVER (PARTITION BY g) AS last FROM s WINDOW w AS (PARTITION BY g ORDER BY r))
       SELECT g, round(avg(gap * gap), 8) AS rps FROM k WHERE r < last GROUP BY g""",
)
def dm32(spark, sf):
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.col("c_nationkey").alias("g"), F.col("o_orderpriority").alias("r")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("g"))).withColumn("o", F.when(F.col("r") == "2-HIGH", 1.0).otherwise(0.0))
    return S.rps(shares, ["g"], "r", "p", "o").select("g", F.round("rps", 8).alias("rps"))


SIZES = "WITH d AS (SELECT p_brand, p_size AS x, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS p, 20 AS y FROM part GROUP BY p_brand, p_size), f AS (SELECT *, sum(p) OVER (PARTITION BY p_brand ORDER BY x) AS cdf FROM d)"


def _sizes(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("x")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("p_brand"))).withColumn("y", F.lit(20)).withColumn("u", F.lit(0.5))


@query("dm33_crps", SIZES + " SELECT p_brand, round(sum(p * abs(x - y)) - sum(p * x * (2 * cdf - p - 1)), 6) AS crps FROM f GROUP BY p_brand")
def dm33(spark, sf):
    return S.crps(_sizes(spark, sf), ["p_brand"], "x", "p", "y").select("p_brand", F.round("crps", 6).alias("crps"))


@query(
    "dm34_pit_and_coverage",
    SIZES + """ SELECT p_brand, round(sum(CASE WHEN x < y THEN p WHEN x = y THEN 0.5 * p ELSE 0 END), 8) AS pit, min(x) FILTER (cdf >= 0.05 - 1e-12) AS low, min(x) FILTER (cdf >= 0.95 - 1e-12) AS high,
    max(y) BETWEEN min(x) FILTER (cdf >= 0.05 - 1e-12) AND min(x) FILTER (cdf >= 0.95 - 1e-12) AS covered FROM f GROUP BY p_brand""",
)
def dm34(spark, sf):
    return S.pit_and_coverage(_sizes(spark, sf), ["p_brand"], "x", "p", "y", "u", 0.9).select("p_brand", F.round("pit", 8).alias("pit"), "low", "high", "covered")


@query("dm35_fractional_brier", "SELECT l_orderkey, l_linenumber, round(l_tax * l_tax - 2 * l_tax * l_discount + l_discount, 9) AS brier FROM lineitem")
def dm35(spark, sf):
    p, o = F.col("l_tax"), F.col("l_discount")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(p * p - 2 * p * o + o, 9).alias("brier"))


@query(
    "dm36_panel_summary",
    """SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS season, round(avg(l_discount - l_tax), 8) AS bias, round(sqrt(avg(pow(l_discount - l_tax, 2))), 8) AS rmse, count(*) AS n
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, year(l_shipdate)))""",
)
def dm36(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("season"), (F.col("l_discount") - F.col("l_tax")).alias("gap"))
    sql = "SELECT l_returnflag, season, round(avg(gap), 8) AS bias, round(sqrt(avg(gap * gap)), 8) AS rmse, count(*) AS n FROM {rows} GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, season))"
    return spark.sql(sql, rows=rows)


@query(
    "dm37_clustered_comparison",
    """WITH s AS (SELECT year(o_orderdate) AS season, avg(ln(1 + o_totalprice)) - avg(ln(1 + o_custkey)) AS delta FROM orders GROUP BY 1) SELECT count(*) AS seasons, round(avg(delta), 7) AS mean_delta, count(*) FILTER (delta > 0) AS worse FROM s""",
)
def dm37(spark, sf):
    seasons = load(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("season")).agg((F.avg(F.log1p("o_totalprice")) - F.avg(F.log1p("o_custkey"))).alias("delta"))
    return seasons.agg(F.count("*").alias("seasons"), F.round(F.avg("delta"), 7).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("worse"))


@query(
    "dm37_season_bootstrap",
    """WITH s AS (SELECT o_orderpriority AS scope, year(o_orderdate) AS season, avg(ln(1 + o_totalprice)) - avg(ln(1 + o_custkey)) AS delta FROM orders GROUP BY 1, 2) SELECT scope, round(avg(delta), 6) AS estimate, true AS interval_holds FROM s GROUP BY scope""",
)
def dm37b(spark, sf):
    """Whole seasons are drawn, so that what a season's matches share stays together."""
    delta = F.avg(F.log1p("o_totalprice")) - F.avg(F.log1p("o_custkey"))
    seasons = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scope"), F.year("o_orderdate").alias("season")).agg(delta.alias("delta"))
    return _interval(S.block_bootstrap(seasons.withColumn("one", F.lit(1)), ["scope"], "delta", "one"))


@query(
    "dm38_match_week_origins",
    """WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS season, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
       SELECT CAST(season AS INTEGER) AS season, CAST(r // 10 AS INTEGER) AS week, d + 1 AS origin FROM m WHERE r IN (60, 120, 190, 300)""",
)
def dm38(spark, sf):
    place = F.row_number().over(Window.partitionBy(F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey"))
    rows = load(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("d"), place.alias("r"))
    return rows.filter(F.col("r").isin(60, 120, 190, 300)).select("season", F.floor(F.col("r") / 10).cast("int").alias("week"), F.date_add("d", 1).alias("origin"))


#: Every 2,000 order keys are a season, so that a season has a bounded number of matches.
MATCHES = """WITH m AS (SELECT l_orderkey // 2000 AS season, l_orderkey AS id, l_suppkey % 20 AS home, (l_suppkey + 1 + l_partkey % 19) % 20 AS away, CAST(l_quantity AS INT) % 4 AS hg, CAST(l_linenumber AS INT) % 3 AS ag FROM lineitem),
  s AS (SELECT season, home AS team, away AS opp, hg AS gf, ag AS ga FROM m UNION ALL SELECT season, away, home, ag, hg FROM m),
  t AS (SELECT season, team, count(*) AS played, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS points, sum(gf - ga) AS gd, sum(gf) AS gf FROM s GROUP BY season, team)"""
SEASON = ["season"]


def _matches(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 2000).alias("season"),
        F.col("l_orderkey").alias("match_id"),
        (F.col("l_suppkey") % 20).alias("home"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 19) % 20).alias("away"),
        (F.col("l_quantity").cast("int") % 4).alias("home_goals"),
        (F.col("l_linenumber").cast("int") % 3).alias("away_goals"),
    )


def _sanctions(spark, sf):
    """Six points of a team in every other season."""
    return _matches(spark, sf).filter("season % 2 = 0").select("season").distinct().select("season", F.lit(3).cast("long").alias("team"), F.lit(-6).cast("long").alias("adjustment"))


DEDUCTED = "points - CASE WHEN team = 3 AND season % 2 = 0 THEN 6 ELSE 0 END"


@query("ag12_league_table", MATCHES + f" SELECT season, team, played, CAST({DEDUCTED} AS BIGINT) AS points, CAST(gd AS BIGINT) AS gd, CAST(gf AS BIGINT) AS gf FROM t")
def ag12(spark, sf):
    return T.league_table(_matches(spark, sf), _sanctions(spark, sf), SEASON).select("season", "team", "played", "points", "gd", "gf")


@query(
    "ag13_head_to_head",
    MATCHES + """, k AS (SELECT season, team, points // 8 AS grp FROM t) SELECT s.season, s.team, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS h2h_points, CAST(sum(gf - ga) AS BIGINT) AS h2h_gd
    FROM s JOIN k a ON a.season = s.season AND a.team = s.team JOIN k b ON b.season = s.season AND b.team = s.opp AND a.grp = b.grp GROUP BY s.season, s.team""",
)
def ag13(spark, sf):
    table = T.league_table(_matches(spark, sf), keys=SEASON).select("season", "team", F.floor(F.col("points") / 8).alias("tie"))
    return T.head_to_head(_matches(spark, sf), table, SEASON).select("season", "team", "h2h_points", "h2h_gd")


@query(
    "dm24_tie_mass",
    MATCHES + """, r AS (SELECT season, team, rank() OVER (PARTITION BY season ORDER BY points // 20 DESC) AS first, count(*) OVER (PARTITION BY season, points // 20) AS n FROM t)
    SELECT season, team, CAST(first + i AS INT) AS position, round(1.0 / n, 9) AS mass FROM r, range(0, 20) x(i) WHERE i < n""",
)
def dm24(spark, sf):
    table = T.league_table(_matches(spark, sf), keys=SEASON).withColumn("key", F.floor(F.col("points") / 20))
    return T.position_mass(table, SEASON, ["key"]).select("season", "team", "position", F.round("mass", 9).alias("mass"))


SHORT = """WITH m AS (SELECT l_orderkey // 60 AS season, l_orderkey AS id, l_suppkey % 40 AS home, (l_suppkey + 1 + l_partkey % 39) % 40 AS away, CAST(l_linenumber AS INT) % 2 AS hg, CAST(l_quantity AS INT) % 2 AS ag FROM lineitem),
  s AS (SELECT season, home AS team, away AS opp, hg AS gf, ag AS ga, 0 AS at_away FROM m UNION ALL SELECT season, away, home, ag, hg, 1 FROM m),
  t AS (SELECT season, team, count(*) AS played, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS points, sum(gf - ga) AS gd, sum(gf) AS gf, count(*) FILTER (gf > ga) AS wins, sum(gf * at_away) AS away_goals FROM s GROUP BY season, team),
  h AS (SELECT s.season, s.team, sum(CASE WHEN s.gf > s.ga THEN 3 WHEN s.gf = s.ga THEN 1 ELSE 0 END) AS hp, sum(s.gf - s.ga) AS hd, sum(s.gf) AS hg
        FROM s JOIN t a ON a.season = s.season AND a.team = s.team JOIN t b ON b.season = s.season AND b.team = s.opp AND a.points = b.points AND a.gd = b.gd AND a.gf = b.gf GROUP BY s.season, s.team),
  r AS (SELECT t.*, coalesce(hp, 0) AS hp, coalesce(hd, 0) AS hd, coalesce(hg, 0) AS hg FROM t LEFT JOIN h USING (season, team))"""
ORDER = "points DESC, gd DESC, gf DESC, hp DESC, hd DESC, hg DESC, wins DESC, away_goals DESC"


@query(
    "dm24_tie_break_ranking",
    SHORT + f""" SELECT season, team, CAST(points AS BIGINT) AS points, CAST(rank() OVER (PARTITION BY season ORDER BY {ORDER}) AS INTEGER) AS position_from,
    CAST(rank() OVER (PARTITION BY season ORDER BY {ORDER}) + count(*) OVER (PARTITION BY season, points, gd, gf, hp, hd, hg, wins, away_goals) - 1 AS INTEGER) AS position_to FROM r""",
)
def dm24b(spark, sf):
    matches = load(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 60).alias("season"),
        F.col("l_orderkey").alias("match_id"),
        (F.col("l_suppkey") % 40).alias("home"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 39) % 40).alias("away"),
        (F.col("l_linenumber").cast("int") % 2).alias("home_goals"),
        (F.col("l_quantity").cast("int") % 2).alias("away_goals"),
    )
    return T.ranked_table(matches, "efl", SEASON).select("season", "team", "points", "position_from", "position_to")


PATHS = """WITH p AS (SELECT o_orderkey AS path, o_orderstatus AS outcome, o_orderpriority AS team, CASE WHEN o_totalprice > 50000 THEN 1.0 ELSE 0.0 END AS x FROM orders),
  c AS (SELECT team, outcome, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM p GROUP BY ALL), b AS (SELECT team, count(*) AS n, avg(x) AS base FROM p GROUP BY team)"""


@query(
    "dm28_conditional_impacts",
    PATHS + """ SELECT c.team, c.outcome, c.n, round(m, 9) AS conditional, round(sqrt(v / c.n), 9) AS standard_error FROM c""",
)
def dm28(spark, sf):
    return T.conditional_means(_paths(spark, sf), ["team"], "outcome", "x").select("team", "outcome", "n", F.round("conditional", 9).alias("conditional"), F.round("standard_error", 9).alias("standard_error"))


def _paths(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("outcome"), F.when(F.col("o_totalprice") > 50000, 1.0).otherwise(0.0).alias("x"))


def _unconditional(spark, sf):
    return _paths(spark, sf).groupBy("team").agg(F.avg("x").alias("baseline"))


@query(
    "dm28_impact_summary",
    PATHS + """ SELECT c.team, round(any_value(base), 9) AS baseline, round(sqrt(sum(c.n * pow(m - base, 2)) / sum(c.n)), 9) AS rms, round(max(m) - min(m), 9) AS swing, abs(sum(c.n * m) / sum(c.n) - any_value(base)) < 1e-9 AS recovered
    FROM c JOIN b ON b.team = c.team GROUP BY c.team""",
)
def dm28b(spark, sf):
    means = T.conditional_means(_paths(spark, sf), ["team"], "outcome", "x")
    return T.impact_summary(means, ["team"], _unconditional(spark, sf)).select("team", F.round("baseline", 9).alias("baseline"), F.round("rms", 9).alias("rms"), F.round("swing", 9).alias("swing"), "recovered")


@query(
    "so06_rank_by_movement",
    PATHS + """, r AS (SELECT c.team, sqrt(sum(c.n * pow(m - base, 2)) / sum(c.n)) AS rms FROM c JOIN b ON b.team = c.team GROUP BY c.team) SELECT team, CAST(row_number() OVER (ORDER BY round(rms, 9) DESC, team) AS INTEGER) AS place FROM r""",
)
def so06(spark, sf):
    summary = T.impact_summary(T.conditional_means(_paths(spark, sf), ["team"], "outcome", "x"), ["team"], _unconditional(spark, sf))
    return summary.select("team", F.row_number().over(Window.orderBy(F.desc(F.round("rms", 9)), "team")).alias("place"))


@query(
    "dm27_distribution_summary",
    """WITH c AS (SELECT p_brand, p_size AS x, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY x) / sum(n) OVER (PARTITION BY p_brand) AS cdf FROM c)
       SELECT p_brand, round(sum(n * x) / sum(n), 8) AS mean, round(sqrt(sum(n * x * x) / sum(n) - pow(sum(n * x) / sum(n), 2)), 7) AS sd, min(x) FILTER (cdf >= 0.5) AS median,
         min(x) FILTER (cdf >= 0.25) AS low50, min(x) FILTER (cdf >= 0.75) AS high50, min(x) FILTER (cdf >= 0.1) AS low80, min(x) FILTER (cdf >= 0.9) AS high80 FROM f GROUP BY p_brand""",
)
def dm27(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("x")).agg(F.count("*").alias("n"))
    return T.distribution_summary(counts, ["p_brand"], "x", "n")


@query(
    "dm40_sanction_gaps",
    """WITH p AS (SELECT o_custkey, row_number() OVER w AS played, sum(CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER w AS pts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
       s AS (SELECT c_custkey AS o_custkey, 4 AS played, 6 - c_custkey % 4 AS stated FROM customer) SELECT o_custkey, CAST(pts AS BIGINT) AS prefix_points, CAST(stated - pts AS BIGINT) AS adjustment FROM p JOIN s USING (o_custkey, played) WHERE stated <> pts""",
)
def dm40(spark, sf):
    points = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prefix = load(spark, sf, "orders").select("o_custkey", F.row_number().over(order).alias("played"), F.sum(points).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("prefix_points"))
    stated = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(4).alias("played"), (6 - F.col("c_custkey") % 4).alias("stated"))
    gaps = prefix.filter("played = 4").join(stated, ["o_custkey", "played"]).filter("stated <> prefix_points")
    return gaps.select("o_custkey", "prefix_points", (F.col("stated") - F.col("prefix_points")).alias("adjustment"))


@query(
    "dm40_sanction_derivation",
    """WITH m AS (SELECT l_orderkey // 2000 AS season, l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS d, l_suppkey % 20 AS home, (l_suppkey + 1 + l_partkey % 19) % 20 AS away, CAST(l_quantity AS INT) % 4 AS hg, CAST(l_linenumber AS INT) % 3 AS ag FROM lineitem),
       s AS (SELECT season, id, d, home AS team, hg AS gf, ag AS ga FROM m UNION ALL SELECT season, id, d, away, ag, hg FROM m),
       p AS (SELECT season, team, row_number() OVER w AS played, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w AS pts, sum(gf - ga) OVER w AS gd FROM s WINDOW w AS (PARTITION BY season, team ORDER BY d, id ROWS UNBOUNDED PRECEDING)),
       t AS (SELECT c_custkey // 20 AS season, c_custkey % 20 AS team, 5 AS played, 6 - c_custkey % 4 AS points, c_custkey % 9 - 4 AS stated_gd FROM customer),
       g AS (SELECT t.*, CASE WHEN gd = stated_gd THEN points - pts END AS gap FROM t LEFT JOIN p USING (season, team, played)),
       r AS (SELECT * FROM g LEFT JOIN (SELECT c_custkey // 20 AS season, c_custkey % 20 AS team, -3 AS reviewed FROM customer WHERE c_custkey % 6 = 0) USING (season, team))
       SELECT season, team, CASE WHEN reviewed IS NOT NULL THEN CASE WHEN gap <> reviewed THEN 'contradicted' ELSE 'reviewed' END WHEN gap IS NULL THEN 'unknown' WHEN gap <> 0 THEN 'adjusted' ELSE 'agrees' END AS state,
         CAST(CASE WHEN reviewed IS NOT NULL THEN reviewed WHEN gap <> 0 THEN gap END AS BIGINT) AS adjustment, CASE WHEN reviewed IS NOT NULL THEN DATE '2024-03-01' WHEN gap <> 0 THEN DATE '2024-07-02' END AS known_on FROM r""",
)
def dm40b(spark, sf):
    """Customers state tables after five matches; some are reviewed, some describe other results."""
    key = F.col("c_custkey")
    matches = load(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 2000).alias("season"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id"),
        F.to_date("l_shipdate").alias("match_date"),
        (F.col("l_suppkey") % 20).alias("home"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 19) % 20).alias("away"),
        (F.col("l_quantity").cast("int") % 4).alias("home_goals"),
        (F.col("l_linenumber").cast("int") % 3).alias("away_goals"),
    )
    customers = load(spark, sf, "customer").select(F.floor(key / 20).alias("season"), (key % 20).alias("team"), "c_custkey")
    late = F.lit("2024-07-01 23:30:00").cast("timestamp")  # the next day in London
    standings = customers.select("season", "team", F.lit(5).alias("played"), (6 - key % 4).alias("points"), (key % 9 - 4).alias("goal_difference"), late.alias("retrieved_at"))
    reviewed = customers.filter(key % 6 == 0).select("season", "team", F.lit(-3).alias("adjustment"), F.lit("2024-03-01").cast("date").alias("known_on"))
    return T.derived_adjustments(standings, matches, SEASON, reviewed).select("season", "team", "state", "adjustment", "known_on")


@query(
    "dm41_prospective_record",
    """WITH f AS (SELECT user_id, ts, event_id, value / 201.0 AS p FROM events WHERE event_type = 'view'), k AS (SELECT user_id, min(ts) AS kickoff, arg_min(value, (ts, event_id)) > 100 AS won FROM events WHERE event_type = 'purchase' GROUP BY user_id),
       l AS (SELECT k.user_id, won, arg_max(p, (f.ts, f.event_id)) AS p FROM k JOIN f ON f.user_id = k.user_id AND f.ts < k.kickoff GROUP BY k.user_id, won)
       SELECT user_id, round(p, 9) AS p, won, round(-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN won THEN p ELSE 1 - p END))), 7) AS log_loss FROM l""",
)
def dm41(spark, sf):
    events = load(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase"))
    view = F.col("event_type") == "view"
    kickoff = F.min(F.when(~view, F.struct("ts", "event_id", "value"))).over(Window.partitionBy("user_id"))
    rows = events.withColumn("kick", kickoff).filter(view & (F.col("ts") < F.col("kick.ts")))
    last = rows.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.first("kick.value").alias("result"))
    p, won = F.col("value") / F.lit(201.0), F.col("result") > 100
    return last.select("user_id", F.round(p, 9).alias("p"), won.alias("won"), F.round(S.log_loss(F.when(won, p).otherwise(1 - p)), 7).alias("log_loss"))


@query(
    "dm42_series_pivot",
    """SELECT user_id, list(CAST(ts AS DATE) ORDER BY ts, event_id) AS days, list(round(value, 3) ORDER BY ts, event_id) AS series FROM events WHERE event_type = 'signup' GROUP BY user_id""",
)
def dm42(spark, sf):
    rows = load(spark, sf, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("rows"))
    return rows.select("user_id", F.transform("rows.ts", lambda x: F.to_date(x)).alias("days"), F.transform("rows.value", lambda x: F.round(x, 3)).alias("series"))


@query(
    "dm43_hindcast_boundary",
    """WITH b AS (SELECT event_type, min(CAST(ts AS DATE)) + 10 AS live FROM events GROUP BY event_type) SELECT e.event_type, count(*) FILTER (CAST(ts AS DATE) < live) AS retro, count(*) FILTER (CAST(ts AS DATE) >= live) AS prospective FROM events e JOIN b USING (event_type) GROUP BY e.event_type""",
)
def dm43(spark, sf):
    days = load(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    live = F.date_add(F.min("day").over(Window.partitionBy("event_type")), 10)
    return days.withColumn("live", live).groupBy("event_type").agg(F.coalesce(F.sum(F.when(F.col("day") < F.col("live"), F.col("n"))), F.lit(0)).alias("retro"), F.coalesce(F.sum(F.when(F.col("day") >= F.col("live"), F.col("n"))), F.lit(0)).alias("prospective"))


@query(
    "dm44_publication_projection",
    GRID + """ SELECT k, h AS home_goals, a AS away_goals, CAST(round(CAST(p AS DECIMAL(20, 12)), 6) AS DOUBLE) AS p FROM c WHERE p > 5e-7""",
)
def dm44(spark, sf):
    grid = P.score_grid(_rates(spark, sf), ["k"], F.col("lh"), F.col("la"))
    # Exact decimals of twelve digits are rounded, so that a tie does not hang on a double's last bit.
    exact = F.round(F.col("probability").cast("decimal(20,12)"), 6).cast("double")
    return grid.filter("probability > 5e-7").select("k", F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"), exact.alias("p"))


@query(
    "dm39_truth_table",
    MATCHES + f""" SELECT season, team, CAST(row_number() OVER (PARTITION BY season ORDER BY {DEDUCTED} DESC, gd DESC, gf DESC, team) AS INTEGER) AS position FROM t""",
)
def dm39(spark, sf):
    order = Window.partitionBy("season").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return T.league_table(_matches(spark, sf), _sanctions(spark, sf), SEASON).select("season", "team", F.row_number().over(order).alias("position"))


@query(
    "dm46_verification",
    """SELECT 'discount_range' AS check_name, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS subject FROM lineitem WHERE l_discount > 0.095
       UNION ALL SELECT 'positive_price', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice <= 0
       UNION ALL SELECT 'known_nation', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
       UNION ALL SELECT 'late_event', CAST(event_id AS VARCHAR) FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'""",
)
def dm46(spark, sf):
    from fieldbook.operators.verify import Check, violations

    return violations([
        Check("discount_range", load(spark, sf, "lineitem"), F.col("l_discount") > 0.095, ["l_orderkey", "l_linenumber"]),
        Check("positive_price", load(spark, sf, "orders"), F.col("o_totalprice") <= 0, ["o_orderkey"]),
        Check("known_nation", load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"), F.lit(True), ["c_custkey"]),
        Check("late_event", load(spark, sf, "events"), F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), ["event_id"]),
    ])


@query(
    "dm48_content_dedupe",
    """SELECT sha256(p_type) AS digest, min(p_type) AS document, count(*) AS uses FROM part GROUP BY 1""",
)
def dm48(spark, sf):
    return load(spark, sf, "part").groupBy(F.sha2("p_type", 256).alias("digest")).agg(F.min("p_type").alias("document"), F.count("*").alias("uses"))


@query(
    "dm47_effective_revision",
    """WITH r AS (SELECT o_custkey AS root, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS depth FROM orders) SELECT root, id AS effective, depth FROM r WHERE r = 1""",
)
def dm47(spark, sf):
    last = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("root")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"), F.count("*").alias("depth"))
    return last.select("root", F.col("last.o_orderkey").alias("effective"), "depth")


@query(
    "dm49_retention_plan",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'referenced' WHEN d.n_chars > 2000 THEN 'grace' ELSE 'delete' END AS action FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
)
def dm49(spark, sf):
    from fieldbook.operators.verify import retention_plan

    inventory = load(spark, sf, "documents").select("doc_id", "n_chars")
    return retention_plan(inventory, load(spark, sf, "labels").select("doc_id"), "doc_id", F.col("n_chars") > 2000).select("doc_id", "action")


@query(
    "dm50_coverage_audit",
    """SELECT n_name, count(*) AS customers, count(*) FILTER (o.o_custkey IS NULL) AS without_orders, round(avg(CASE WHEN o.o_custkey IS NULL THEN 0.0 ELSE 1.0 END), 9) AS coverage
       FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY n_name""",
)
def dm50(spark, sf):
    active = load(spark, sf, "orders").select("o_custkey").distinct()
    rows = load(spark, sf, "customer").join(active, F.col("o_custkey") == F.col("c_custkey"), "left").join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    missing = F.col("o_custkey").isNull()
    return rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(missing).alias("without_orders"), F.round(F.avg(F.when(missing, 0.0).otherwise(1.0)), 9).alias("coverage"))


@query(
    "dm01_reconciliation",
    """WITH p AS (SELECT o_custkey AS match, o_orderpriority AS provider, o_orderdate AS seen, o_orderkey AS id, o_orderstatus = 'F' AS finished, CAST(floor(o_totalprice) AS INT) AS score FROM orders),
       c AS (SELECT match, arg_max(id, (provider = '1-URGENT', seen, provider, id)) AS chosen, arg_max(finished, (provider = '1-URGENT', seen, provider, id)) AS done FROM p GROUP BY match),
       f AS (SELECT match, arg_max(score, (seen, id)) FILTER (finished) AS score, bool_or(finished) AS any_done FROM p GROUP BY match)
       SELECT match, chosen, any_done AS finished, NOT done AND any_done AS taken_over, score FROM c JOIN f USING (match)""",
)
def dm01(spark, sf):
    orders = load(spark, sf, "orders")
    rows = orders.select(F.col("o_custkey").alias("match"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("finished"), F.floor("o_totalprice").cast("int").alias("score"))
    order = F.struct(F.col("provider") == "1-URGENT", "at", "provider", "id")
    grouped = rows.groupBy("match").agg(F.max_by(F.struct("id", "finished"), order).alias("row"), F.max_by("score", F.when(F.col("finished"), F.struct("at", "id"))).alias("any_score"), F.bool_or("finished").alias("any_done"))
    return grouped.select("match", F.col("row.id").alias("chosen"), F.col("any_done").alias("finished"), (~F.col("row.finished") & F.col("any_done")).alias("taken_over"), F.when(F.col("any_done"), F.col("any_score")).alias("score"))


@query(
    "dm03_source_hand_over",
    """WITH n AS (SELECT event_type, min(CAST(ts AS DATE)) + 7 AS first FROM events GROUP BY event_type), o AS (SELECT event_id, event_type, CAST(ts AS DATE) AS d, event_id % 2 AS provider FROM events)
       SELECT event_id, event_type, provider FROM o JOIN n USING (event_type) WHERE (provider = 1 AND d >= first) OR (provider = 0 AND d < first)""",
)
def dm03(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("d"), (F.col("event_id") % 2).alias("provider"))
    first = rows.groupBy("event_type").agg(F.date_add(F.min("d"), 7).alias("first"))
    kept = ((F.col("provider") == 1) & (F.col("d") >= F.col("first"))) | ((F.col("provider") == 0) & (F.col("d") < F.col("first")))
    return rows.join(first, "event_type").filter(kept).select("event_id", "event_type", "provider")


@query("dm02_training_rows", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS match_date FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND CAST(o_orderdate AS DATE) + 1 <= DATE '1996-01-01'")
def dm02(spark, sf):
    day = F.to_date("o_orderdate")
    done = (F.col("o_orderstatus") == "F") & F.col("o_totalprice").isNotNull() & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))
    return load(spark, sf, "orders").filter(done).select("o_orderkey", "o_custkey", day.alias("match_date"))


@query(
    "dm16_personnel_continuity",
    """WITH w AS (SELECT user_id, event_id, least(CAST(floor(value) AS INT), 90) AS minutes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, event_type FROM events),
       k AS (SELECT * FROM w WHERE r <= 8), t AS (SELECT user_id, sum(minutes) AS total, sum(minutes) FILTER (event_type IN ('view', 'click')) AS represented, sum(minutes) FILTER (event_type = 'error') AS unresolved FROM k GROUP BY user_id)
       SELECT user_id, round(1 - coalesce(represented, 0) / (total - coalesce(unresolved, 0)), 9) AS discontinuity, coalesce(unresolved, 0) / total <= 0.25 AS usable FROM t WHERE total > coalesce(unresolved, 0)""",
)
def dm16(spark, sf):
    from fieldbook.operators.relops import first_per_key

    events = load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.least(F.floor("value").cast("int"), F.lit(90)).alias("minutes"))
    recent = first_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 8)
    part = lambda *kinds: F.coalesce(F.sum(F.when(F.col("event_type").isin(*kinds), F.col("minutes"))), F.lit(0))
    sums = recent.groupBy("user_id").agg(F.sum("minutes").alias("total"), part("view", "click").alias("represented"), part("error").alias("unresolved")).filter("total > unresolved")
    return sums.select("user_id", F.round(1 - F.col("represented") / (F.col("total") - F.col("unresolved")), 9).alias("discontinuity"), (F.col("unresolved") / F.col("total") <= 0.25).alias("usable"))


# --- what a viewer derives


@query(
    "vw01_parallel_arrays",
    """WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS e, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id, event_id // 3000), x AS (SELECT user_id, unnest(e) AS event, unnest(v) AS value FROM a)
       SELECT user_id, event, round(max(value) - min(value), 9) AS swing, count(*) AS n FROM x GROUP BY user_id, event""",
)
def vw01(spark, sf):
    # A user's arrays are in blocks, so that none grows with the table.
    arrays = load(spark, sf, "events").groupBy("user_id", F.floor(F.col("event_id") / 3000).alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("r"))
    rows = arrays.select("user_id", F.inline(F.arrays_zip(F.col("r.event_type").alias("event"), F.col("r.value").alias("value"))))
    return rows.groupBy("user_id", "event").agg(F.round(F.max("value") - F.min("value"), 9).alias("swing"), F.count("*").alias("n"))


@query("vw02_event_peak", "SELECT event_type, max(value) AS peak, arg_max(user_id, (value, -event_id)) AS club FROM events GROUP BY event_type")
def vw02(spark, sf):
    top = load(spark, sf, "events").groupBy("event_type").agg(F.max(F.struct("value", -F.col("event_id"), "user_id")).alias("top"))
    return top.select("event_type", F.col("top.value").alias("peak"), F.col("top.user_id").alias("club"))


@query("vw03_bars_to_peak", "SELECT p_brand, p_size, round(count(*) / max(count(*)) OVER (PARTITION BY p_brand), 9) AS bar FROM part GROUP BY p_brand, p_size")
def vw03(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return counts.select("p_brand", "p_size", F.round(F.col("n") / F.max("n").over(Window.partitionBy("p_brand")), 9).alias("bar"))


@query("vw04_displayed_version", "SELECT c_nationkey, coalesce(max(c_mktsegment) FILTER (c_mktsegment = 'MACHINERY' AND c_acctbal > 9000), max(c_mktsegment)) AS version FROM customer GROUP BY c_nationkey")
def vw04(spark, sf):
    shown = F.max(F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 9000), F.col("c_mktsegment")))
    return load(spark, sf, "customer").groupBy("c_nationkey").agg(F.coalesce(shown, F.max("c_mktsegment")).alias("version"))
