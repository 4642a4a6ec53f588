"""The relations of the analysis namespace over whole tables, one query for each group.

Evidence is made of orders, suppliers, nations, regions and parts; documents of customers,
50 to a document. What the relations give is put in long form: relation, id, item, value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.plans import analysis
from fieldbook.plans.registry import query
from fieldbook.session import load
from fieldbook.sources.evidence import Frames


def _long(rows: DataFrame, relation: str, key: str, item: list[str], value) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in item])
    return rows.select(F.lit(relation).alias("relation"), F.col(key).alias("id"), name.alias("item"), F.round(value.cast("double"), 9).alias("value"))


def _all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _named(schema: str, row: Column) -> Column:
    """A struct of these fields in the form of a schema: fields that it lacks are null."""
    return F.from_json(F.to_json(row), schema)


# --- evidence

MATCHES = """WITH o AS (SELECT *, o_orderstatus = 'F' OR o_orderkey % 5 = 0 AS done FROM orders),
  m AS (SELECT 'm' || o_orderkey AS match_id, 'c' || (o_custkey % 4) AS competition_id, 't' || (o_custkey % 20) AS home_team_id, 't' || ((o_custkey + 1 + o_orderkey % 18) % 20) AS away_team_id,
    CAST(o_orderdate AS DATE) AS match_date, CASE WHEN done THEN 'finished' ELSE 'scheduled' END AS status, CASE WHEN done THEN o_orderkey % 4 END AS home_goals, CASE WHEN done THEN o_custkey % 3 END AS away_goals, o_orderkey, o_custkey FROM o)"""


def _provided(rows: DataFrame, provider: str, day: int) -> DataFrame:
    at = F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")
    return rows.withColumns({"provider": F.lit(provider), "retrieved_at": at, "source_sha256": F.lit(f"{provider}{day}"), "evidence_basis": F.lit("b"), "normalization_version": F.lit(1)})


def _orders(spark, sf) -> DataFrame:
    key, own = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        text("m", key).alias("match_id"), text("c", own % 4).alias("competition_id"), F.lit("s").alias("season_id"), text("t", own % 20).alias("home_team_id"),
        text("t", (own + 1 + key % 18) % 20).alias("away_team_id"), F.to_date("o_orderdate").alias("match_date"), (key % 4).alias("goals"), (own % 3).alias("other_goals"),
    )


def _evidence(spark, sf) -> Frames:
    orders = _orders(spark, sf)
    finished = lambda rows, done: rows.withColumns({"status": F.when(done, "finished").otherwise("scheduled"), "home_goals": F.when(done, F.col("goals")), "away_goals": F.when(done, F.col("other_goals"))})
    first = _provided(finished(orders, F.col("o_orderstatus") == "F"), "api_football", 1)
    second = _provided(finished(orders.filter("o_orderkey % 5 = 0"), F.lit(True)), "other", 2)
    # The second provider has values of its own from a day on.
    sides = F.array(F.struct(F.col("home_team_id").alias("team_id"), ((F.col("o_orderkey") % 7) / F.lit(4.0)).alias("xg")), F.struct(F.col("away_team_id").alias("team_id"), ((F.col("o_custkey") % 5) / F.lit(4.0)).alias("xg")))
    process = orders.filter("o_orderkey % 3 = 0").select("match_id", "competition_id", "match_date", F.inline(sides))
    later = process.filter("match_date >= DATE'1998-01-01'").withColumn("xg", F.col("xg") + 0.25)
    suppliers = load(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("player_id"), F.col("s_name").alias("name"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("team_id"), "s_suppkey", "s_nationkey")
    nations = load(spark, sf, "nation")
    teams = nations.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("team_id"), F.col("n_name").alias("name"), "n_nationkey")
    regions = load(spark, sf, "region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("competition_id"), "r_regionkey")
    scope = lambda rows, kind, key, count: rows.select(F.lit(kind).alias("scope_kind"), F.col(key).alias("scope_key"), F.lit("e").alias("endpoint"), *([F.col("competition_id"), F.lit("s").alias("season_id")] if "competition_id" in rows.columns else [F.lit(None).cast("string").alias("competition_id"), F.lit(None).cast("string").alias("season_id")]), count.cast("int").alias("row_count"))
    captures = _all(
        _provided(scope(teams, "team_squad", "team_id", F.lit(2)), "api_football", 1),
        _provided(scope(teams, "team_squad", "team_id", F.col("n_nationkey") % 3), "api_football", 2),
        _provided(scope(regions, "competition_injuries", "competition_id", F.col("r_regionkey")), "api_football", 2),
        _provided(scope(regions, "kalshi_series", "competition_id", F.col("r_regionkey") + 1), "kalshi", 3),
        _provided(spark.range(1).select(F.lit("fpl_availability").alias("scope_kind"), F.lit("s").alias("scope_key"), F.lit("e").alias("endpoint"), F.lit(None).cast("string").alias("competition_id"), F.lit("s").alias("season_id"), F.lit(9).alias("row_count")), "fpl", 2),
    )
    squad = suppliers.select("player_id", "team_id", F.lit("s").alias("season_id"), F.lit("captured_squad").alias("basis"), "s_suppkey", "s_nationkey")
    hurt = suppliers.filter("s_suppkey % 4 = 0").select("player_id", "team_id", F.concat(F.lit("c"), (F.col("s_suppkey") % 5).cast("string")).alias("competition_id"), F.lit("s").alias("season_id"), F.lit("fixture:1").alias("scope"), F.lit("out").alias("status"))
    fpl = suppliers.filter("s_suppkey % 6 = 0").select("player_id", "team_id", F.lit("s").alias("season_id"), F.lit("all").alias("scope"), F.lit("doubt").alias("status"))
    parts = load(spark, sf, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("market_ticker"), F.concat(F.lit("t"), (F.col("p_partkey") % 30).cast("string")).alias("team_id"), ((F.col("p_partkey") % 100) / 100).cast("decimal(10,4)").alias("yes_bid"))
    seen = load(spark, sf, "lineitem").select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("match_id"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("player_id"), F.lit("t").alias("team_id"), F.col("l_quantity").cast("int").alias("minutes"))
    union = lambda *some: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)
    return Frames(
        spark,
        {
            "fixtures": first.unionByName(second),
            "team_process": _provided(process, "p1", 1).unionByName(_provided(later, "p2", 2)),
            "players": _provided(suppliers.select("player_id", "name"), "api_football", 1),
            "teams": _provided(teams.select("team_id", "name"), "api_football", 1),
            "source_snapshots": captures,
            "memberships": _provided(squad, "api_football", 1).unionByName(_provided(squad.filter("s_suppkey % 2 = 0 and s_nationkey % 3 > 0"), "api_football", 2)),
            "availability": union(_provided(hurt, "api_football", 2), _provided(fpl, "fpl", 2)),
            "kalshi_markets": _provided(parts, "kalshi", 3),
            "appearances": _provided(seen, "api_football", 1),
        },
    )


def _canonical(spark, sf, name: str) -> DataFrame:
    return analysis.canonical_relations(_evidence(spark, sf))[name]


@query("ns01_session_and_catalogs", "SELECT object_name, column_name, ordinal, described FROM (VALUES ('nation', 'n_nationkey', 1, true), ('nation', 'n_name', 2, true), ('nation', 'n_regionkey', 3, true), ('session', 'batches', 3, true), ('session', 'cutoff', 2, true), ('session', 'loaded_at', 1, true)) AS t(object_name, column_name, ordinal, described)")
def ns01(spark, sf):
    from fieldbook.plans.namespace import Namespace, Relation

    data = Frames(spark, {}, "2026-01-01T00:00:00+00:00")
    space = Namespace(spark, [Relation("session", "session", "The session.", analysis.session_relation(data, "now")), Relation("nation", "nation", "Nations.", load(spark, sf, "nation"))])
    described = space.catalog().select("object_name", F.col("grain").isNotNull().alias("described"))
    return space.column_catalog().join(described, "object_name").select("object_name", "column_name", "ordinal", "described")


@query("ns02_matches", MATCHES + " SELECT match_id, competition_id, home_team_id, away_team_id, match_date, status, home_goals, away_goals, 'api_football' AS provider FROM m")
def ns02(spark, sf):
    rows = _canonical(spark, sf, "matches")
    return rows.select("match_id", "competition_id", "home_team_id", "away_team_id", "match_date", "status", F.col("home_goals").cast("long").alias("home_goals"), F.col("away_goals").cast("long").alias("away_goals"), "provider")


@query(
    "ns03_team_match_xg",
    MATCHES + """, x AS (SELECT *, o_orderkey % 7 / 4.0 AS hx, o_custkey % 5 / 4.0 AS ax FROM m WHERE o_orderkey % 3 = 0), p2 AS (SELECT competition_id, min(match_date) AS start FROM x WHERE match_date >= DATE '1998-01-01' GROUP BY 1)
    SELECT match_id, round(hx + CASE WHEN match_date >= start THEN 0.25 ELSE 0 END, 9)::DOUBLE AS home_xg, round(ax + CASE WHEN match_date >= start THEN 0.25 ELSE 0 END, 9)::DOUBLE AS away_xg FROM x LEFT JOIN p2 USING (competition_id)""",
)
def ns03(spark, sf):
    return _canonical(spark, sf, "team_match_xg").select("match_id", F.round("home_xg", 9).alias("home_xg"), F.round("away_xg", 9).alias("away_xg"))


@query(
    "ns04_team_matches",
    MATCHES + """, s AS (SELECT match_id, home_team_id AS team_id, 'home' AS venue, home_goals AS gf, away_goals AS ga FROM m UNION ALL SELECT match_id, away_team_id, 'away', away_goals, home_goals FROM m)
    SELECT match_id, team_id, venue, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' WHEN gf < ga THEN 'L' END AS result FROM s""",
)
def ns04(spark, sf):
    return _canonical(spark, sf, "team_matches").select("match_id", "team_id", "venue", "result")


@query(
    "ns05_player_matches",
    MATCHES + """ SELECT 'm' || l_orderkey AS match_id, s_name AS player_name, status AS match_status, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS minutes FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN m ON m.o_orderkey = l_orderkey GROUP BY ALL""",
)
def ns05(spark, sf):
    return _canonical(spark, sf, "player_matches").groupBy("match_id", "player_name", "match_status").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


@query(
    "ns06_snapshots",
    """SELECT 'personnel_snapshots' AS relation, 'team_squad' AS scope_kind, 't' || n_nationkey AS scope_key, n_nationkey % 3 AS row_count FROM nation UNION ALL SELECT 'personnel_snapshots', 'competition_injuries', 'c' || r_regionkey, r_regionkey FROM region
       UNION ALL SELECT 'personnel_snapshots', 'fpl_availability', 's', 9 UNION ALL SELECT r, 'kalshi_series', 'c' || r_regionkey, r_regionkey + 1 FROM region, (VALUES ('personnel_snapshots'), ('kalshi_snapshots')) AS v(r)""",
)
def ns06(spark, sf):
    found = analysis.canonical_relations(_evidence(spark, sf))
    return _all(*[found[n].select(F.lit(n).alias("relation"), "scope_kind", "scope_key", "row_count") for n in ("personnel_snapshots", "kalshi_snapshots")])


@query(
    "ns07_memberships_and_availability",
    """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 3 AS rows FROM nation)
       SELECT 'squad_memberships' AS relation, 't' || k AS scope, rows AS row_count, 'p' || s_suppkey AS player_id, s_name AS player_name FROM n LEFT JOIN supplier ON s_nationkey = k AND s_suppkey % 2 = 0 AND k % 3 > 0
       UNION ALL SELECT 'injury_availability', 'c' || r_regionkey, r_regionkey, 'p' || s_suppkey, s_name FROM region LEFT JOIN supplier ON s_suppkey % 5 = r_regionkey AND s_suppkey % 4 = 0
       UNION ALL SELECT 'fpl_availability', 's', 9, 'p' || s_suppkey, s_name FROM (SELECT 1) LEFT JOIN supplier ON s_suppkey % 6 = 0""",
)
def ns07(spark, sf):
    found = analysis.canonical_relations(_evidence(spark, sf))
    scopes = {"squad_memberships": "team_id", "injury_availability": "scope_key", "fpl_availability": "season_id"}
    return _all(*[found[n].select(F.lit(n).alias("relation"), F.col(c).alias("scope"), "row_count", "player_id", "player_name") for n, c in scopes.items()])


@query("ns08_kalshi_markets", "SELECT 'k' || p_partkey AS market_ticker, n_name AS team_name, CAST(p_partkey % 100 / 100.0 AS DOUBLE) AS yes_bid FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30")
def ns08(spark, sf):
    return _canonical(spark, sf, "kalshi_markets").select("market_ticker", "team_name", F.col("yes_bid").cast("double").alias("yes_bid"))


# --- documents

BASE = "WITH c AS (SELECT c_custkey AS k, 'f' || (c_custkey // 50) AS f, c_custkey % 7 AS x, 't' || c_custkey AS t, 'm' || c_custkey AS m FROM customer)"
KEYS = ["competition_id", "season_id"]


def _customers(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    return load(spark, sf, "customer").select(k.alias("k"), text("f", F.floor(k / 50)).alias("f"), (k % 7).alias("x"), text("t", k).alias("t"), text("m", k).alias("m"))


def _documents(spark, sf, key: str, parts: dict[str, Column], scalars: dict[str, Column] | None = None) -> DataFrame:
    """A document for every 50 customers, each field an array of a struct per customer."""
    lists = [F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v"))), lambda a, b: (a["k"] - b["k"]).cast("int")), lambda r: r["v"]).alias(name) for name, c in parts.items()]
    fixed = {"competition_id": F.lit("pl"), "season_id": F.lit("s"), **(scalars or {})}
    grouped = _customers(spark, sf).groupBy(F.col("f").alias(key)).agg(*lists)
    return grouped.select(key, *[c.alias(n) for n, c in fixed.items()], *parts)


def _prob(home: float, plus: int = 20) -> list[Column]:
    p = F.lit(home) + F.col("x") / F.lit(float(plus))
    return [p.alias("p_home"), F.lit(0.25).alias("p_draw"), (F.lit(0.75) - p).alias("p_away")]


def _score() -> Column:
    a = F.col("x") / F.lit(100.0)
    cell = lambda v: F.array(a + v, F.lit(0.2) - a)
    return F.struct((F.lit(1.0) + a).alias("home_rate"), F.lit(0.9).alias("away_rate"), F.lit(0.1).alias("omitted_probability"), F.array(cell(0.3), cell(0.2)).alias("grid_home_rows_away_columns"))


def _match_part() -> Column:
    plain = F.struct(*_prob(0.3), _score().alias("score_distribution"))
    people = F.struct(*_prob(0.31), _score().alias("score_distribution"))
    quote = F.struct(*_prob(0.32), F.lit("f").alias("market_family"), F.struct(F.lit(2.0).alias("home"), F.lit(4.0).alias("draw"), (F.lit(4.0) + F.col("x")).alias("away")).alias("decimal_odds"))
    side = lambda c: F.struct(F.concat(F.lit(c), F.col("t")).alias("team_id"), (F.col("x") / F.lit(10.0) + (0.0 if c == "h" else 0.1)).alias("discontinuity"))
    personnel = F.when(F.col("k") % 2 == 0, F.struct(((F.col("x") - 3) / F.lit(100.0)).alias("home_log_rate_shift"), F.lit(0.5).alias("kappa"), side("h").alias("home"), side("a").alias("away")))
    stages = F.struct(plain.alias("unadjusted"), F.when(F.col("k") % 2 == 0, people).alias("personnel_adjusted"), F.when(F.col("k") % 3 == 0, quote).alias("market_assisted"))
    return _named(analysis._MATCH, F.struct(F.col("m").alias("match_id"), F.concat(F.lit("h"), F.col("t")).alias("home_team_id"), F.concat(F.lit("a"), F.col("t")).alias("away_team_id"), stages.alias("stages"), personnel.alias("personnel")))


def _team_part(kind: str = analysis._TEAM) -> Column:
    p = F.col("x") / F.lit(10.0)
    pair = lambda a, b: F.create_map(F.lit(a), p, F.lit(b), F.lit(1.0) - p)
    spread = lambda n: F.create_map(F.lit("50"), F.array(F.col("x").cast("double"), (F.col("x") + n).cast("double")))
    fields = {
        "team_id": F.col("t"), "name": F.upper("t"), "mean_points": F.lit(40.0) + F.col("x"), "events": pair("champion", "relegated"), "event_probabilities": pair("champion", "relegated"), "points_distribution": pair("50", "51"),
        "goal_difference_distribution": pair("-1", "2"), "position_probabilities": F.array(p, F.lit(1.0) - p), "points_intervals": spread(5), "position_intervals": spread(2), "conditional_europe_probabilities": F.create_map(F.lit("s"), p),
    }
    return _named(kind, F.struct(*[c.alias(n) for n, c in fields.items()]))


def _forecasts(spark, sf, key: str = "forecast_id") -> DataFrame:
    times = {"generated_at": F.lit("2026-01-01 00:00:00").cast("timestamp"), "origin_at": F.lit("2025-12-01 00:00:00").cast("timestamp"), "state_observed_at": F.lit(None).cast("timestamp"), "model_results_cutoff": F.lit(None).cast("date"), "model_version": F.lit("v1")}
    return _documents(spark, sf, key, {"matches": _match_part(), "teams": _team_part()}, times)


def _runs(spark, sf) -> DataFrame:
    state = _named(analysis._STATE, F.struct(F.col("t").alias("team_id"), (F.col("x") / F.lit(10.0)).alias("quality"), F.lit(30).alias("training_matches")))
    spec = _named(analysis._SPECIFICATION, F.struct((F.col("x") / F.lit(10.0)).alias("posterior_weight"), F.lit(0.3).alias("quality_sd")))
    rows = _documents(spark, sf, "forecast_id", {"team_strengths": state, "specifications": spec})
    number = F.substring("forecast_id", 2, 9).cast("int")
    more = {"generated_at": F.lit("2026-01-01 00:00:00").cast("timestamp"), "model_id": F.lit("m"), "model_version": F.lit("v1"), "package_version": F.lit("1"), "code_sha256": F.lit("c"), "training_matches": number + 100, "training_date_max": F.lit("2025-12-31").cast("date"), "league_away_goal_rate": (number % 3) / F.lit(2.0), "home_scoring_multiplier": F.lit(1.2)}
    people = F.struct(F.lit(0.5).alias("kappa"), F.lit(14).alias("horizon_days"), F.lit(3).alias("records"), F.lit(2).alias("adjusted_fixtures"), F.lit(False).alias("persistent_state_changed"))
    return rows.withColumns({**more, "personnel": people, "fit_diagnostics": F.struct("specifications")}).drop("specifications")


@query(
    "ns09_runs_states_specifications",
    BASE + """, d AS (SELECT f, CAST(substr(f, 2) AS INT) AS n FROM c GROUP BY ALL), s AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS i FROM c)
    SELECT 'forecasts' AS relation, f AS id, 'v1' AS item, NULL::DOUBLE AS value FROM d UNION ALL SELECT 'forecast_runs', f, CAST(n + 100 AS VARCHAR), CASE WHEN n % 3 > 0 THEN round(ln(n % 3 / 2.0), 9) END FROM d
    UNION ALL SELECT 'model_team_states', f, t, round(x / 10.0, 9) FROM c UNION ALL SELECT 'model_specifications', f, CAST(i AS VARCHAR), round(x / 10.0, 9) FROM s""",
)
def ns09(spark, sf):
    found = analysis.run_relations(_runs(spark, sf), ["forecast_id"])
    space = analysis.open_namespace(Frames(spark, {}), _forecasts(spark, sf), prefix="ns09_")
    return _all(
        _long(space.relations["forecasts"].rows, "forecasts", "forecast_id", ["public_model_version"], F.lit(None)),
        _long(found["forecast_runs"], "forecast_runs", "forecast_id", ["training_matches"], "league_log_rate"),
        _long(found["model_team_states"], "model_team_states", "forecast_id", ["team_id"], "quality"),
        _long(found["model_specifications"], "model_specifications", "forecast_id", ["specification_index"], "posterior_weight"),
    )


def _match_relations(spark, sf) -> dict[str, DataFrame]:
    return analysis.match_relations(_forecasts(spark, sf), ["forecast_id"])


STAGES = """, st AS (SELECT *, 'unadjusted' AS stage, true AS there, 0.3 AS base FROM c UNION ALL SELECT *, 'personnel_adjusted', k % 2 = 0, 0.31 FROM c UNION ALL SELECT *, 'market_assisted', k % 3 = 0, 0.32 FROM c)"""


@query(
    "ns10_forecast_matches",
    BASE + STAGES + """ SELECT 'forecast_matches' AS relation, f AS id, m || ':h' || t || ':a' || t AS item, NULL::DOUBLE AS value FROM c UNION ALL SELECT 'forecast_match_stages', f, m || ':' || stage || ':' || CAST(there AS VARCHAR) || ':' || CAST(k % 2 = 0 AND x <> 3 AS VARCHAR), CASE WHEN there THEN round(base + x / 20.0, 9) END FROM st
    UNION ALL SELECT 'forecast_market_inputs', f, m || ':f', round(4.0 + x, 9) FROM c WHERE k % 3 = 0""",
)
def ns10(spark, sf):
    found = _match_relations(spark, sf)
    return _all(
        _long(found["forecast_matches"], "forecast_matches", "forecast_id", ["match_id", "home_team_id", "away_team_id"], F.lit(None)),
        _long(found["forecast_match_stages"], "forecast_match_stages", "forecast_id", ["match_id", "stage", "available", "personnel_applied"], "p_home"),
        _long(found["forecast_market_inputs"], "forecast_market_inputs", "forecast_id", ["match_id", "market_family"], "away_odds"),
    )


@query(
    "ns11_forecast_scores",
    BASE + STAGES + """, g AS (SELECT *, h, a FROM st, range(0, 2) AS hh(h), range(0, 2) AS aa(a) WHERE there AND stage <> 'market_assisted')
    SELECT 'forecast_score_distributions' AS relation, f AS id, m || ':' || stage || ':2:2' AS item, round(1 + x / 100.0, 9) AS value FROM st WHERE there AND stage <> 'market_assisted'
    UNION ALL SELECT 'forecast_score_grid', f, m || ':' || stage || ':' || h || ':' || a, round(CASE WHEN a = 1 THEN 0.2 - x / 100.0 WHEN h = 0 THEN x / 100.0 + 0.3 ELSE x / 100.0 + 0.2 END, 9) FROM g""",
)
def ns11(spark, sf):
    found = _match_relations(spark, sf)
    return _all(
        _long(found["forecast_score_distributions"], "forecast_score_distributions", "forecast_id", ["match_id", "stage", "home_goal_values", "away_goal_values"], "home_rate"),
        _long(found["forecast_score_grid"], "forecast_score_grid", "forecast_id", ["match_id", "stage", "home_goals", "away_goals"], "probability"),
    )


def _personnel(spark, sf) -> DataFrame:
    """A record per customer: the home side has a reason not to be used every fifth time."""
    player = lambda n: F.struct(F.concat(F.lit(f"p{n}"), F.col("t")).alias("player_id"), F.lit(0.2).alias("recent_weight"), (F.col("x") / F.lit(10.0)).alias("probability"), F.array(F.lit("squad"), F.lit(f"b{n}")).alias("membership_basis"), F.array(F.lit("news")).alias("availability_basis"))
    reason = F.when(F.col("k") % 5 == 0, "few_matches")
    side = lambda name, why: F.struct(F.lit(name).alias("side"), F.concat(F.lit(name[0]), F.col("t")).alias("team_id"), (F.col("x") / F.lit(10.0)).alias("discontinuity"), F.lit(0.2).alias("unresolved_weight"), why.alias("unusable_reason"), F.array(F.lit("r1"), F.lit("r2")).alias("reference_matches"), F.array(player(1), player(2)).alias("players"))
    shift = F.when(F.col("k") % 5 > 1, (F.col("x") - 3) / F.lit(100.0))
    row = F.struct(F.col("m").alias("match_id"), shift.alias("home_log_rate_shift"), F.lit(0.5).alias("kappa"), F.array(side("home", reason), side("away", F.lit(None).cast("string"))).alias("sides"))
    schema = "struct<" + ",".join(f"{n}:{t}" for n, t in (f.split(" ", 1) for f in ("match_id string", "home_log_rate_shift double", "kappa double"))) + f",sides:{analysis.PERSONNEL.split('sides ', 1)[1]}>"
    return _customers(spark, sf).select(F.col("f").alias("forecast_id"), _named(schema, row).alias("r")).select("forecast_id", "r.*")


@query(
    "ns12_forecast_personnel",
    BASE + """, s AS (SELECT *, side FROM c, (VALUES ('home'), ('away')) AS v(side)), y AS (SELECT *, k % 5 > 1 AS moved, (x - 3) / 100.0 AS shift FROM s), p AS (SELECT *, i FROM s, range(1, 3) AS r(i))
    SELECT 'forecast_personnel_teams' AS relation, f AS id, m || ':' || substr(side, 1, 1) || t || ':' || CASE WHEN moved THEN CASE WHEN shift <> 0 THEN 'applied' ELSE 'neutral' END WHEN side = 'home' AND k % 5 = 0 THEN 'few_matches' WHEN k % 5 = 0 THEN 'other_team_unusable' ELSE 'shift_unavailable' END AS item,
      CASE WHEN moved THEN round(CASE WHEN side = 'home' THEN shift ELSE 0 - shift END, 9) END AS value FROM y
    UNION ALL SELECT 'forecast_personnel_players', f, m || ':' || side || ':p' || i || t, round(0.2 * (1 - x / 10.0) / 0.8, 9) FROM p
    UNION ALL SELECT 'forecast_personnel_evidence', f, m || ':' || side || ':p' || i || t || ':' || kind || ':' || o || ':' || CASE WHEN kind = 'availability_basis' THEN 'news' WHEN o = 1 THEN 'squad' ELSE 'b' || i END, NULL FROM p, (VALUES ('membership_basis', 1), ('membership_basis', 2), ('availability_basis', 1)) AS v(kind, o)
    UNION ALL SELECT 'forecast_personnel_reference_matches', f, m || ':' || side || ':r' || i, NULL FROM p""",
)
def ns12(spark, sf):
    found = analysis.personnel_relations(_personnel(spark, sf), ["forecast_id"])
    return _all(
        _long(found["forecast_personnel_teams"], "forecast_personnel_teams", "forecast_id", ["match_id", "team_id", "status"], "team_log_rate_shift"),
        _long(found["forecast_personnel_players"], "forecast_personnel_players", "forecast_id", ["match_id", "side", "player_id"], "discontinuity_contribution"),
        _long(found["forecast_personnel_evidence"], "forecast_personnel_evidence", "forecast_id", ["match_id", "side", "player_id", "evidence_kind", "ordinal", "basis"], F.lit(None)),
        _long(found["forecast_personnel_reference_matches"], "forecast_personnel_reference_matches", "forecast_id", ["match_id", "side", "reference_match_id"], F.lit(None)),
    )


def _team_sql(product: str, relations: str) -> str:
    """What the teams of a document say, as the relations of a product."""
    parts = {
        "teams": "SELECT '{r}teams' AS relation, f AS id, t || ':' || upper(t) AS item, round(40.0 + x, 9) AS value FROM c",
        "events": "SELECT '{r}team_events', f, t || ':' || e, round(CASE WHEN e = 'champion' THEN x / 10.0 ELSE 1 - x / 10.0 END, 9) FROM c, (VALUES ('champion'), ('relegated')) AS v(e)",
        "points": "SELECT '{r}points_distribution', f, t || ':' || e, round(CASE WHEN e = 50 THEN x / 10.0 ELSE 1 - x / 10.0 END, 9) FROM c, (VALUES (50), (51)) AS v(e)",
        "positions": "SELECT '{r}position_distribution', f, t || ':' || e, round(CASE WHEN e = 1 THEN x / 10.0 ELSE 1 - x / 10.0 END, 9) FROM c, (VALUES (1), (2)) AS v(e)",
        "intervals": "SELECT '{r}intervals', f, t || ':' || e || ':50', round(CAST(x + d AS DOUBLE), 9) FROM c, (VALUES ('points', 5), ('position', 2)) AS v(e, d)",
        "goals": "SELECT '{r}goal_difference_distribution', f, t || ':' || e, round(CASE WHEN e = -1 THEN x / 10.0 ELSE 1 - x / 10.0 END, 9) FROM c, (VALUES (-1), (2)) AS v(e)",
        "europe": "SELECT '{r}europe_probabilities', f, t || ':s', round(x / 10.0, 9) FROM c",
        "frequencies": "SELECT '{r}match_frequencies', f, m, 0.5 FROM c",
        "runs": "SELECT '{r}runs', f, '10', CAST(count(*) AS DOUBLE) FROM c GROUP BY f",
    }
    return " UNION ALL ".join(parts[p].format(r=product) for p in relations.split())


def _team_long(found: dict[str, DataFrame], product: str, key: str) -> list[DataFrame]:
    items = {"teams": ["team_id", "team_name"], "team_events": ["team_id", "event"], "points_distribution": ["team_id", "points"], "position_distribution": ["team_id", "position"], "intervals": ["team_id", "estimate", "level"], "goal_difference_distribution": ["team_id", "goal_difference"], "europe_probabilities": ["team_id", "scenario"], "match_frequencies": ["match_id"], "runs": ["simulations"]}
    values = {"teams": "mean_points", "intervals": "upper", "match_frequencies": "p_home", "runs": "played_matches"}
    return [_long(found[f"{product}{n}"], f"{product}{n}", key, item, values.get(n, "probability")) for n, item in items.items() if f"{product}{n}" in found]


@query("ns13_season_documents", f"{BASE} {_team_sql('forecast_', 'teams events points positions intervals')} UNION ALL {_team_sql('hindcast_', 'teams events points positions intervals')}")
def ns13(spark, sf):
    return _all(*[x for product, key in (("forecast", "forecast_id"), ("hindcast", "hindcast_id")) for x in _team_long(analysis.document_relations(_forecasts(spark, sf, key), product, [key]), f"{product}_", key)])


SIMULATED = "teams events points positions intervals goals europe frequencies runs"


@query("ns14_simulations", f"{BASE} {_team_sql('forecast_simulation_', SIMULATED)} UNION ALL {_team_sql('hindcast_simulation_', SIMULATED)}")
def ns14(spark, sf):
    out = []
    for product in ("forecast", "hindcast"):
        key = f"{product}_id"
        pairs = F.struct(F.col("m"), F.struct(F.lit(0.5).alias("p_home"), F.lit(0.3).alias("p_draw"), F.lit(0.2).alias("p_away")))
        rows = _documents(spark, sf, key, {"teams": _team_part(analysis._SIM_TEAM), "pairs": pairs}, {"simulations": F.lit(10)})
        rows = rows.withColumns({"match_frequencies": F.map_from_entries("pairs"), "played_matches": F.size("pairs")}).drop("pairs")
        out += _team_long(analysis.simulation_relations(rows, product, [key]), f"{product}_simulation_", key)
    return _all(*out)


@query(
    "ns15_impacts",
    BASE + """, y AS (SELECT *, o, v FROM c, (VALUES ('home', 0.1), ('draw', 0.2), ('away', 0.3)) AS z(o, v))
    SELECT 'forecast_impact_fixtures' AS relation, f AS id, m || ':' || CAST(x > 2 AS VARCHAR) AS item, CAST(x * 100 AS DOUBLE) AS value FROM c
    UNION ALL SELECT 'forecast_impacts', f, m || ':champion:' || t || ':' || o, round(v + x / 100.0, 9) FROM y
    UNION ALL SELECT 'baselines', f, m || ':' || o, round(CASE WHEN k % 2 = 0 THEN 0.5 ELSE x / 10.0 END, 9) FROM y""",
)
def ns15(spark, sf):
    each = lambda v: F.array(F.lit(v) + F.col("x") / F.lit(100.0))
    # Every other block leaves its baseline out: it is the team's own probability then.
    block = F.struct(F.array(F.col("t")).alias("team_id"), F.when(F.col("k") % 2 == 0, F.array(F.lit(0.5))).alias("baseline"), each(0.1).alias("home"), each(0.2).alias("draw"), each(0.3).alias("away"))
    counts = F.struct((F.col("x") * 100).alias("home"), F.lit(1).cast("long").alias("draw"), F.lit(1).cast("long").alias("away"))
    fixture = F.struct(F.col("m").alias("match_id"), (F.col("x") > 2).alias("sufficient_sample"), counts.alias("outcome_counts"), F.create_map(F.lit("champion"), block).alias("impacts"))
    schema = analysis.IMPACT.split("fixtures array<", 1)[1][:-1]
    documents = _documents(spark, sf, "forecast_id", {"fixtures": _named(schema, fixture)}, {"horizon_days": F.lit(14), "window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp"), "coverage": F.lit("all"), "minimum_conditional_samples": F.lit(100)})
    own = analysis.document_relations(_forecasts(spark, sf), "forecast", ["forecast_id"])["forecast_team_events"]
    found = analysis.impact_relations(documents, ["forecast_id"], own)
    return _all(
        _long(found["forecast_impact_fixtures"], "forecast_impact_fixtures", "forecast_id", ["match_id", "sufficient_sample"], "outcome_count_home"),
        _long(found["forecast_impacts"], "forecast_impacts", "forecast_id", ["match_id", "event", "team_id", "outcome"], "conditional_probability"),
        _long(found["forecast_impacts"], "baselines", "forecast_id", ["match_id", "outcome"], "baseline"),
    )


@query("ns16_hindcast_origins", BASE + " SELECT f AS hindcast_id, 'v1' AS model_version, TIMESTAMP '2025-12-01 00:00:00' AS origin_at FROM c GROUP BY f")
def ns16(spark, sf):
    space = analysis.open_namespace(Frames(spark, {}), None, _forecasts(spark, sf, "hindcast_id"), prefix="ns16_")
    return space.relations["hindcast_origins"].rows.select("hindcast_id", "model_version", F.col("origin_at").cast("timestamp_ntz").alias("origin_at"))


def _match_hindcasts(spark, sf) -> dict[str, DataFrame]:
    match = F.struct(F.col("m").alias("match_id"), *_prob(0.3), F.struct(*_prob(0.29)).alias("unadjusted"), F.struct(((F.col("x") - 3) / F.lit(100.0)).alias("home_log_rate_shift")).alias("personnel"), _score().alias("score_probabilities"))
    schema = analysis.HINDCAST.split("matches array<", 1)[1][:-1]
    documents = _documents(spark, sf, "model_version", {"matches": _named(schema, match)}, {"prospective_from": F.lit("2026-08-01").cast("date")})
    return analysis.match_hindcast_relations(documents)


@query(
    "ns17_match_hindcasts",
    BASE + """ SELECT 'match_hindcasts' AS relation, f AS id, m AS item, round(0.29 + x / 20.0, 9) AS value FROM c UNION ALL SELECT 'match_hindcast_score_grid', f, m || ':' || h || ':' || a, round(CASE WHEN a = 1 THEN 0.2 - x / 100.0 WHEN h = 0 THEN x / 100.0 + 0.3 ELSE x / 100.0 + 0.2 END, 9) FROM c, range(0, 2) AS hh(h), range(0, 2) AS aa(a)""",
)
def ns17(spark, sf):
    found = _match_hindcasts(spark, sf)
    return _all(
        _long(found["match_hindcasts"], "match_hindcasts", "model_version", ["match_id"], "unadjusted_p_home"),
        _long(found["match_hindcast_score_grid"], "match_hindcast_score_grid", "model_version", ["match_id", "home_goals", "away_goals"], "probability"),
    )


@query(
    "ns18_record",
    BASE + """ SELECT CASE WHEN k % 2 = 0 THEN 'settled' ELSE 'pending' END AS relation, f AS id, m AS item, round(0.3 + x / 20.0, 9) AS value FROM c UNION ALL SELECT 'record_summary', f, 'overall', CAST(count(*) FILTER (k % 2 = 0) AS DOUBLE) FROM c GROUP BY f""",
)
def ns18(spark, sf):
    row = F.struct(F.col("m").alias("match_id"), F.col("f").alias("forecast_id"), *_prob(0.3), (F.col("k") % 2 == 0).alias("done"))
    documents = _documents(spark, sf, "forecast_id", {"rows": row})
    summary = F.create_map(F.lit("overall"), F.struct(F.size(F.filter("rows", lambda r: r["done"])).cast("long").alias("scored")))
    flat = documents.select("forecast_id", F.filter("rows", lambda r: ~r["done"]).alias("pending"), F.filter("rows", lambda r: r["done"]).alias("settled"), summary.alias("summary"))
    found = analysis.record_relations(flat)
    summaries = flat.select("forecast_id", F.explode("summary").alias("scope", "v")).select("forecast_id", "scope", "v.scored")
    assert set(found["record_summary"].columns) >= {"scope", "scored", "metrics"}
    return _all(_long(found["record_matches"].withColumn("none", F.lit(None)), "x", "forecast_id", ["match_id"], "p_home").withColumn("relation", F.when(F.substring("item", 2, 12).cast("long") % 2 == 0, "settled").otherwise("pending")), _long(summaries, "record_summary", "forecast_id", ["scope"], "scored"))


def _space(spark, sf, prefix: str):
    return analysis.open_namespace(Frames(spark, {}), _forecasts(spark, sf), _forecasts(spark, sf, "hindcast_id"), prefix=prefix)


@query("ns19_team_projections", BASE + " SELECT p AS product, p = 'hindcast' AS retrospective, f AS id, t AS team_id, round(40.0 + x, 9) AS mean_points FROM c, (VALUES ('live'), ('hindcast')) AS v(p)")
def ns19(spark, sf):
    rows = _space(spark, sf, "ns19_").sql("SELECT * FROM ns19_team_projections")
    return rows.select("product", "retrospective", F.coalesce("forecast_id", "hindcast_id").alias("id"), "team_id", F.round("mean_points", 9).alias("mean_points"))


@query(
    "ns20_team_event_probabilities",
    BASE + """ SELECT p AS product, f AS id, upper(t) AS team_name, e AS event, round(CASE WHEN e = 'champion' THEN x / 10.0 ELSE 1 - x / 10.0 END, 9) AS probability, CASE WHEN p = 'live' THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2025-12-01 00:00:00' END AS observed_at FROM c, (VALUES ('live'), ('hindcast')) AS v(p), (VALUES ('champion'), ('relegated')) AS w(e)""",
)
def ns20(spark, sf):
    rows = _space(spark, sf, "ns20_").sql("SELECT * FROM ns20_team_event_probabilities")
    return rows.select("product", F.coalesce("forecast_id", "hindcast_id").alias("id"), "team_name", "event", F.round("probability", 9).alias("probability"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query(
    "ns21_stage_comparison",
    BASE + """ SELECT f AS forecast_id, m AS match_id, round(0.3 + x / 20.0, 9) AS unadjusted, CASE WHEN k % 2 = 0 THEN round(0.31 + x / 20.0, 9) END AS adjusted, CASE WHEN k % 3 = 0 THEN round(0.32 + x / 20.0, 9) END AS assisted, k % 2 = 0 AND x <> 3 AS personnel_applied,
    CASE WHEN k % 2 = 0 THEN round(x / 10.0 + 0.1, 9) END AS away_gap FROM c""",
)
def ns21(spark, sf):
    rows = _space(spark, sf, "ns21_").sql("SELECT * FROM ns21_forecast_match_stage_comparison")
    return rows.select("forecast_id", "match_id", F.round("unadjusted_p_home", 9).alias("unadjusted"), F.round("personnel_adjusted_p_home", 9).alias("adjusted"), F.round("market_assisted_p_home", 9).alias("assisted"), "personnel_applied", F.round("D_away", 9).alias("away_gap"))


@query(
    "ns22_match_hindcast_outcomes",
    MATCHES + """ SELECT 'f' || (c_custkey // 50) AS model_version, 'm' || c_custkey AS match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' WHEN home_goals < away_goals THEN 'A' END AS outcome FROM customer LEFT JOIN m ON match_id = 'm' || c_custkey""",
)
def ns22(spark, sf):
    found = analysis.derived_relations({"matches": _canonical(spark, sf, "matches"), "match_hindcasts": _match_hindcasts(spark, sf)["match_hindcasts"]})
    return found["match_hindcast_outcomes"].select("model_version", "match_id", "outcome")
