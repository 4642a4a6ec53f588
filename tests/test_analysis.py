"""The namespace over a small store and small documents."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldbook.plans import analysis
from fieldbook.session import scratch
from fieldbook.sources import evidence


def request(day, provider="api_football"):
    return {"provider": provider, "retrieved_at": f"2026-01-{day:02d}T00:00:00+00:00", "evidence_basis": "b", "source_sha256": f"s{day}{provider}"}


FIXTURE = "match_id string, competition_id string, season_id string, home_team_id string, away_team_id string, match_date string, status string, home_goals int, away_goals int"


def fixtures(spark, *rows):
    return spark.createDataFrame(rows, FIXTURE).withColumn("match_date", F.to_date("match_date"))


@pytest.fixture(scope="module")
def data(spark):
    root = scratch(spark, "analysis")
    put = lambda day, provider="api_football", **tables: evidence.publish(spark, root, request(day, provider), tables)
    put(1, fixtures=fixtures(spark, ("m1", "pl", "2025-26", "a", "b", "2025-08-10", "scheduled", None, None), ("m2", "pl", "2025-26", "b", "a", "2025-09-10", "scheduled", None, None)))
    put(2, "other", fixtures=fixtures(spark, ("m1", "pl", "2025-26", "a", "b", "2025-08-10", "finished", 1, 0)))
    put(2, players=spark.createDataFrame([("one", "Player One")], "player_id string, name string"))
    snap = lambda n: spark.createDataFrame([("team_squad", "arsenal", "squads", n)], "scope_kind string, scope_key string, endpoint string, row_count int")
    put(3, source_snapshots=snap(1), memberships=spark.createDataFrame([("one", "arsenal", "2025-26", "captured_squad")], "player_id string, team_id string, season_id string, basis string"))
    put(4, source_snapshots=snap(0))
    put(5, team_process=spark.createDataFrame([("m1", "a", "pl", 1.5), ("m1", "b", "pl", 0.5), ("m2", "a", "pl", 1.0)], "match_id string, team_id string, competition_id string, xg double"))
    return root


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_a_finished_score_of_another_provider_stands_in(spark, data):
    found = analysis.canonical_relations(evidence.Dataset(spark, data))
    assert rows(found["matches"], "match_id", "status", "home_goals", "provider") == [("m1", "finished", 1, "api_football"), ("m2", "scheduled", None, "api_football")]
    assert rows(found["team_matches"].filter("match_id = 'm1'"), "team_id", "venue", "result") == [("a", "home", "W"), ("b", "away", "L")]
    assert rows(found["team_matches"].filter("match_id = 'm2'"), "result") == [(None,), (None,)]
    assert rows(found["team_match_xg"], "match_id", "home_xg", "away_xg") == [("m1", 1.5, 0.5)]
    early = analysis.canonical_relations(evidence.Dataset(spark, data, "2026-01-01T12:00:00+00:00"))
    assert rows(early["matches"], "match_id", "status") == [("m1", "scheduled"), ("m2", "scheduled")]


def test_contradictions_raise(spark):
    root = scratch(spark, "analysis")
    for provider, goals in (("x", 1), ("y", 2)):
        evidence.publish(spark, root, request(1, provider), {"fixtures": fixtures(spark, ("m1", "pl", "s", "a", "b", "2025-08-10", "finished", goals, 0))})
    with pytest.raises(PySparkException):
        analysis.matches(evidence.Dataset(spark, root)).collect()


def test_an_empty_capture_is_a_row_of_nulls(spark, data):
    at = lambda cutoff: rows(analysis.canonical_relations(evidence.Dataset(spark, data, cutoff))["squad_memberships"], "team_id", "row_count", "player_id", "player_name")
    assert at("2026-01-03T12:00:00+00:00") == [("arsenal", 1, "one", "Player One")]
    assert at(None) == [("arsenal", 0, None, None)]


def document(**ids):
    score = {"home_rate": 1.2, "away_rate": 1.0, "omitted_probability": 0.1, "grid_home_rows_away_columns": [[0.3, 0.2], [0.3, 0.1]]}
    stage = {"p_home": 0.5, "p_draw": 0.3, "p_away": 0.2, "score_distribution": score}
    quote = {"p_home": 0.4, "p_draw": 0.3, "p_away": 0.3, "market_family": "f", "decimal_odds": {"home": 2.0, "draw": 4.0, "away": 4.0}}
    people = {"home_log_rate_shift": 0.1, "kappa": 0.5, "home": {"team_id": "a", "discontinuity": 0.1}, "away": {"team_id": "b", "discontinuity": 0.3}}
    team = lambda t: {"team_id": t, "name": t.upper(), "mean_points": 50.5, "events": {"champion": 0.25, "top_4": 0.5}, "points_distribution": {"50": 0.5, "51": 0.5}, "position_probabilities": [0.25, 0.75], "points_intervals": {"50": [48, 53], "90": [40, 60]}, "position_intervals": {"50": [1, 2]}}
    return {"competition_id": "pl", "season_id": "2025-26", "model_version": "v1", "generated_at": "2026-01-01T00:00:00Z", "origin_at": "2025-12-01T00:00:00Z", "matches": [{"match_id": "m1", "home_team_id": "a", "away_team_id": "b", "stages": {"unadjusted": stage, "personnel_adjusted": stage, "market_assisted": quote}, "personnel": people}, {"match_id": "m2", "stages": {"unadjusted": stage}}], "teams": [team("a"), team("b")], **ids}


@pytest.fixture(scope="module")
def space(spark, data):
    read = lambda key, n: spark.read.schema(f"{key} string, {analysis.DOCUMENT}").json(spark.sparkContext.parallelize([json.dumps(document(**{key: f"{key[0]}{k}"})) for k in range(n)]))
    return analysis.open_namespace(evidence.Dataset(spark, data), read("forecast_id", 2), read("hindcast_id", 1))


def count(space, name):
    return space.relations[name].rows.count()


def test_relations_of_documents(space):
    assert [count(space, n) for n in ("forecast_matches", "forecast_match_stages", "forecast_score_distributions", "forecast_score_grid", "forecast_market_inputs", "forecast_personnel_teams")] == [4, 12, 6, 24, 2, 4]
    assert [count(space, n) for n in ("forecast_teams", "forecast_team_events", "forecast_points_distribution", "forecast_position_distribution", "forecast_intervals", "hindcast_team_events")] == [4, 8, 8, 8, 12, 4]
    stages = rows(space.sql("SELECT * FROM analysis_forecast_match_stages WHERE forecast_id = 'f0' AND match_id = 'm2'"), "stage", "parent_stage", "available", "availability_reason", "personnel_applied")
    assert stages[0] == ("market_assisted", "personnel_adjusted", False, "No usable market quote was available.", False)
    assert stages[2] == ("unadjusted", "model_state", True, None, False)


def test_derived_views(space):
    wide = space.sql("SELECT * FROM analysis_forecast_match_stage_comparison WHERE forecast_id = 'f0' AND match_id = 'm1'").first()
    assert (wide.unadjusted_p_home, wide.market_assisted_p_home, wide.personnel_applied, wide.D_home, wide.D_away, wide.kappa) == (0.5, 0.4, True, 0.1, 0.3, 0.5)
    both = space.sql("SELECT product, retrospective, count(*) AS n, count(DISTINCT observed_at) AS t FROM analysis_team_event_probabilities GROUP BY 1, 2")
    assert rows(both, "product", "retrospective", "n") == [("hindcast", True, 4), ("live", False, 8)]
    assert rows(space.sql("SELECT product, count(*) AS n FROM analysis_team_projections GROUP BY 1"), "product", "n") == [("hindcast", 2), ("live", 4)]
    sums = space.sql("SELECT forecast_id, match_id, stage, sum(probability) AS p FROM analysis_forecast_score_grid GROUP BY 1, 2, 3")
    assert sums.filter("abs(p - 0.9) > 1e-9").isEmpty()


def test_every_relation_is_described(space):
    assert {r.object_name for r in space.catalog().collect()} == set(space.relations)
    assert {r.object_name for r in space.search("forecast stage").collect()} >= {"forecast_match_stages"}


def test_hindcast_outcomes(spark, data):
    played = analysis.matches(evidence.Dataset(spark, data))
    hindcasts = spark.createDataFrame([("m1", 0.5), ("m2", 0.4), ("m9", 0.3)], "match_id string, p_home double")
    found = analysis.derived_relations({"matches": played, "match_hindcasts": hindcasts})["match_hindcast_outcomes"]
    assert rows(found, "match_id", "outcome") == [("m1", "H"), ("m2", None), ("m9", None)]


def read(spark, schema, *documents):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(d) for d in documents]))


def test_simulation_relations(spark):
    team = {"team_id": "a", "name": "A", "mean_points": 50.0, "event_probabilities": {"champion_probability": 0.5}, "points_distribution": {"50": 1.0}, "goal_difference_distribution": {"-1": 0.5, "2": 0.5}, "position_probabilities": [0.5, 0.5], "points_intervals": {"50": [1, 2]}, "position_intervals": {"90": [1, 2]}, "conditional_europe_probabilities": {"s": 0.1}}
    runs = read(spark, f"forecast_id string, {analysis.SIMULATION}", {"forecast_id": "f", "simulations": 10, "teams": [team, {**team, "team_id": "b"}], "match_frequencies": {"m": {"p_home": 0.5, "p_draw": 0.3, "p_away": 0.2}}})
    found = analysis.simulation_relations(runs, "forecast", ["forecast_id"])
    assert {k.removeprefix("forecast_simulation_"): v.count() for k, v in found.items()} == {"runs": 1, "teams": 2, "team_events": 2, "points_distribution": 2, "position_distribution": 4, "goal_difference_distribution": 4, "intervals": 4, "europe_probabilities": 2, "match_frequencies": 1}
    assert rows(found["forecast_simulation_goal_difference_distribution"].filter("team_id = 'a'"), "goal_difference") == [(-1,), (2,)]


def test_impacts_fall_back_to_the_team_s_own_probability(spark):
    block = {"team_id": ["a", "b"], "home": [0.4, 0.1], "draw": [0.3], "away": [0.2, 0.3], "rms_movement": [0.05, 0.06]}
    impacts = read(spark, f"forecast_id string, {analysis.IMPACT}", {"forecast_id": "f", "horizon_days": 21, "fixtures": [{"match_id": "m", "outcome_counts": {"home": 5}, "impacts": {"champion": block}}, {"match_id": "n", "unavailable_reason": "x"}]})
    own = spark.createDataFrame([("f", "a", "champion", 0.33)], "forecast_id string, team_id string, event string, probability double")
    found = analysis.impact_relations(impacts, ["forecast_id"], own)
    assert found["forecast_impact_fixtures"].count() == 2
    assert rows(found["forecast_impacts"], "team_id", "outcome", "baseline", "conditional_probability") == [("a", "away", 0.33, 0.2), ("a", "draw", 0.33, 0.3), ("a", "home", 0.33, 0.4), ("b", "away", None, 0.3), ("b", "draw", None, None), ("b", "home", None, 0.1)]


def test_personnel_relations(spark):
    player = lambda p, q: {"player_id": p, "recent_weight": 0.5, "probability": q, "membership_basis": ["x", "y"], "availability_basis": ["z"]}
    side = lambda s, reason: {"side": s, "team_id": s, "discontinuity": 0.2, "unresolved_weight": 0.2, "unusable_reason": reason, "reference_matches": ["r1", "r2"], "players": [player("p", 0.6), player("q", None)]}
    records = read(spark, f"forecast_id string, {analysis.PERSONNEL}", {"forecast_id": "f", "match_id": "1", "home_log_rate_shift": 0.1, "sides": [side("home", None), side("away", None)]}, {"forecast_id": "f", "match_id": "2", "sides": [side("home", None), side("away", "unresolved")]}, {"forecast_id": "f", "match_id": "3", "home_log_rate_shift": 0.0, "sides": [side("home", None), side("away", None)]})
    found = analysis.personnel_relations(records, ["forecast_id"])
    assert rows(found["forecast_personnel_teams"], "match_id", "side", "status", "team_log_rate_shift") == [("1", "away", "applied", -0.1), ("1", "home", "applied", 0.1), ("2", "away", "unresolved", None), ("2", "home", "other_team_unusable", None), ("3", "away", "neutral", -0.0), ("3", "home", "neutral", 0.0)]
    assert [round(r[0], 9) if r[0] else None for r in rows(found["forecast_personnel_players"].filter("match_id = '1' and side = 'home'"), "discontinuity_contribution")] == [0.25, None]
    assert found["forecast_personnel_evidence"].count() == 3 * 2 * 2 * 3 and found["forecast_personnel_reference_matches"].count() == 12


def test_hindcasts_and_record(spark):
    match = {"match_id": "m", "match_date": "2025-01-01", "p_home": 0.5, "unadjusted": {"p_home": 0.4}, "personnel": {"home_log_rate_shift": 0.1}, "score_probabilities": {"home_rate": 1.0, "grid_home_rows_away_columns": [[0.1, 0.2], [0.3, 0.4]]}}
    found = analysis.match_hindcast_relations(read(spark, analysis.HINDCAST, {"model_version": "v", "competition_id": "pl", "season_id": "s", "prospective_from": "2025-06-01", "matches": [match, {"match_id": "n", "match_date": "2025-01-02"}]}))
    assert rows(found["match_hindcasts"], "match_id", "unadjusted_p_home", "personnel_applied", "home_rate") == [("m", 0.4, True, 1.0), ("n", None, False, None)]
    assert rows(found["match_hindcast_score_grid"], "home_goals", "away_goals", "probability") == [(0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.3), (1, 1, 0.4)]
    record = read(spark, analysis.RECORD, {"pending": [{"match_id": "m", "forecast_id": "f"}], "settled": [{"match_id": "n", "forecast_id": "f", "outcome": "H"}], "summary": {"all": {"scored": 1, "log_loss": 0.9}}})
    found = analysis.record_relations(record)
    assert rows(found["record_matches"], "record_state", "match_id", "outcome") == [("pending", "m", None), ("settled", "n", "H")]
    assert rows(found["record_summary"], "scope", "scored") == [("all", 1)]


def test_integrity_finds_what_is_seeded(spark, space):
    from fieldbook.plans import integrity

    found = {n: r.rows for n, r in space.relations.items()}
    clean = {r.check_name for r in integrity.broken(found).collect()}
    assert clean == {"grid_outcomes"}  # the small grid of the fixture leaves its tail unexplained
    seeded = dict(found)
    seeded["forecast_match_stages"] = found["forecast_match_stages"].withColumn("p_home", F.when(F.col("match_id") == "m1", F.col("p_home") + 0.01).otherwise(F.col("p_home")))
    seeded["forecast_position_distribution"] = found["forecast_position_distribution"].withColumn("probability", F.col("probability") * 0.9)
    seeded["forecast_team_events"] = found["forecast_team_events"].withColumn("team_id", F.when(F.col("event") == "top_4", "nobody").otherwise(F.col("team_id")))
    seeded["forecast_matches"] = found["forecast_matches"].unionAll(found["forecast_matches"])
    seeded["match_hindcasts"] = spark.createDataFrame([("v", "pl", "s", "m", "2025-07-01", "2025-06-01", 0.5, 0.3, 0.2)], "model_version string, competition_id string, season_id string, match_id string, match_date string, prospective_from string, p_home double, p_draw double, p_away double")
    seeded["record_matches"] = spark.createDataFrame([("m", "v", 0.5, 0.3, 0.1)], "match_id string, model_version string, p_home double, p_draw double, p_away double")
    names = {r.check_name for r in integrity.broken(seeded).collect()}
    assert names >= {"probability_sum:forecast_match_stages", "probability_sum:record_matches", "distribution_sum:forecast_position_distribution", "orphan_events:forecast", "grain:forecast_matches", "retrospective_dates", "retrospective_and_prospective"}
