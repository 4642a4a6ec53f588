"""Integrity rules across the analysis relations, each a DataFrame of what breaks it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.relops import grain_violations
from fieldbook.operators.verify import Check, violations

# Tolerances, and the columns that tell one row of a relation from another.
PROBABILITY = 2e-6
GRID = 2e-4
DISTRIBUTION = 1e-4
_FORECAST = ["forecast_id", "competition_id", "season_id"]
GRAINS = {
    "matches": ["match_id"],
    "team_matches": ["match_id", "team_id"],
    "team_match_xg": ["match_id"],
    "personnel_snapshots": ["scope_kind", "scope_key"],
    "forecast_matches": [*_FORECAST, "match_id"],
    "forecast_match_stages": [*_FORECAST, "match_id", "stage"],
    "forecast_score_distributions": [*_FORECAST, "match_id", "stage"],
    "forecast_score_grid": [*_FORECAST, "match_id", "stage", "home_goals", "away_goals"],
    "forecast_personnel_teams": [*_FORECAST, "match_id", "side"],
    "forecast_teams": [*_FORECAST, "team_id"],
    "forecast_team_events": [*_FORECAST, "team_id", "event"],
    "forecast_points_distribution": [*_FORECAST, "team_id", "points"],
    "forecast_position_distribution": [*_FORECAST, "team_id", "position"],
    "forecast_intervals": [*_FORECAST, "team_id", "estimate", "level"],
    "match_hindcasts": ["model_version", "competition_id", "season_id", "match_id"],
    "match_hindcast_score_grid": ["model_version", "competition_id", "season_id", "match_id", "home_goals", "away_goals"],
}


def _near(a, b, tolerance: float):
    return F.abs(a - b) <= tolerance


def checks(found: Mapping[str, DataFrame]) -> list[Check]:
    """All rules over the relations that are there."""
    out = [Check(f"grain:{n}", grain_violations(found[n], keys), F.lit(True), keys) for n, keys in GRAINS.items() if n in found and set(keys) <= set(found[n].columns)]
    three = F.col("p_home") + F.col("p_draw") + F.col("p_away")
    for name in ("forecast_match_stages", "match_hindcasts", "record_matches", "forecast_simulation_match_frequencies"):
        if name in found:
            rows = found[name].filter("p_home is not null")
            keys = [c for c in (*_FORECAST, "model_version", "match_id", "stage") if c in rows.columns]
            out.append(Check(f"probability_sum:{name}", rows, ~_near(three, F.lit(1.0), PROBABILITY), keys))
    for name in [n for n in found if n.endswith(("points_distribution", "position_distribution", "goal_difference_distribution"))]:
        rows, value = found[name], name.removesuffix("_distribution").rpartition("_")[2].replace("difference", "goal_difference")
        keys = [c for c in rows.columns if c not in ("probability", value)]
        out.append(Check(f"distribution_sum:{name}", rows.groupBy(*keys).agg(F.sum("probability").alias("p")), ~_near(F.col("p"), F.lit(1.0), DISTRIBUTION), keys))
    if {"forecast_score_grid", "forecast_score_distributions", "forecast_match_stages"} <= found.keys():
        keys = [*[c for c in _FORECAST if c in found["forecast_score_grid"].columns], "match_id", "stage"]
        h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("probability")
        part = lambda where, name: F.sum(F.when(where, p).otherwise(0.0)).alias(name)
        grid = found["forecast_score_grid"].groupBy(*keys).agg(F.sum(p).alias("total"), part(h > a, "g_home"), part(h == a, "g_draw"), part(h < a, "g_away"))
        both = grid.join(found["forecast_score_distributions"].select(*keys, "omitted_probability"), keys).join(found["forecast_match_stages"].select(*keys, "p_home", "p_draw", "p_away"), keys)
        out.append(Check("grid_total", both, ~_near(F.col("total") + F.col("omitted_probability"), F.lit(1.0), GRID), keys))
        off = F.greatest(*[F.abs(F.col(f"g_{o}") - F.col(f"p_{o}")) for o in ("home", "draw", "away")])
        out.append(Check("grid_outcomes", both, off > F.col("omitted_probability") + GRID, keys))
    if "forecast_match_stages" in found:
        rows = found["forecast_match_stages"]
        keys = [*[c for c in _FORECAST if c in rows.columns], "match_id"]
        stage = lambda name: rows.filter(F.col("stage") == name).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("p_home", "p_draw", "p_away")], F.col("personnel_applied").alias(f"{name}_applied"))
        pair = stage("unadjusted").join(stage("personnel_adjusted"), keys).filter("unadjusted_p_home is not null and personnel_adjusted_p_home is not null and not personnel_adjusted_applied")
        off = F.greatest(*[F.abs(F.col(f"unadjusted_{c}") - F.col(f"personnel_adjusted_{c}")) for c in ("p_home", "p_draw", "p_away")])
        out.append(Check("neutral_stage", pair, off > PROBABILITY, keys))
    if "forecast_personnel_teams" in found and "home_log_rate_shift" in found["forecast_personnel_teams"].columns:
        rows = found["forecast_personnel_teams"]
        keys = [c for c in (*_FORECAST, "match_id") if c in rows.columns]
        gap = F.max(F.when(F.col("side") == "away", F.col("discontinuity"))) - F.max(F.when(F.col("side") == "home", F.col("discontinuity")))
        sides = rows.groupBy(*keys).agg((F.max("kappa") * gap).alias("want"), F.max("home_log_rate_shift").alias("shift"))
        out.append(Check("personnel_shift", sides.filter("shift is not null and want is not null"), ~_near(F.col("want"), F.col("shift"), PROBABILITY), keys))
        if "forecast_personnel_players" in found:
            team = [*keys, "team_id"]
            sums = found["forecast_personnel_players"].groupBy(*team).agg(F.sum("discontinuity_contribution").alias("total"))
            out.append(Check("player_contributions", sums.join(rows.filter("usable_for_shift").select(*team, "discontinuity"), team).filter("total is not null"), ~_near(F.col("total"), F.col("discontinuity"), PROBABILITY), team))
    for product in ("forecast", "hindcast"):
        if f"{product}_team_events" in found:
            events, teams = found[f"{product}_team_events"], found[f"{product}_teams"]
            keys = [c for c in (f"{product}_id", "competition_id", "season_id", "team_id") if c in events.columns]
            out.append(Check(f"orphan_events:{product}", events.join(teams.select(*keys), keys, "left_anti"), F.lit(True), [*keys, "event"]))
    if "match_hindcasts" in found:
        rows = found["match_hindcasts"]
        out.append(Check("retrospective_dates", rows, F.col("match_date") >= F.col("prospective_from"), ["model_version", "match_id"]))
        if "record_matches" in found:
            both = rows.join(found["record_matches"].select("match_id", "model_version"), ["match_id", "model_version"], "left_semi")
            out.append(Check("retrospective_and_prospective", both, F.lit(True), ["model_version", "match_id"]))
    return out


def broken(found: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, subject) of everything that breaks a rule."""
    return violations(checks(found))
