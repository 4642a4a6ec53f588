"""Relations of the analysis namespace, from the evidence store and from forecast documents.

All of them are lazy. Nested documents are read once with a declared schema; a relation is
an explode of a part of them, so columns that a query does not ask for are never unpacked.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.relops import latest_per_key, pivot_stages
from fieldbook.plans.namespace import Namespace, Relation
from fieldbook.sources.evidence import Dataset

# The stages of a match forecast with their order and parent, why a stage is
# not there, the states of a personnel adjustment, and the field names of forecast documents.
STAGES = [("unadjusted", 1, "model_state"), ("personnel_adjusted", 2, "unadjusted"), ("market_assisted", 3, "personnel_adjusted")]
NO_QUOTE = "No usable market quote was available."
NO_STAGE = "The artifact does not contain this stage."
APPLIED, NEUTRAL, OTHER_TEAM, NO_SHIFT = "applied", "neutral", "other_team_unusable", "shift_unavailable"
_SCORE = "struct<home_rate:double,away_rate:double,omitted_probability:double,grid_home_rows_away_columns:array<array<double>>>"
_STAGE = f"struct<p_home:double,p_draw:double,p_away:double,market_family:string,market_observed_at:timestamp,market_weight:double,raw_implied_probability_sum:double,decimal_odds:struct<home:double,draw:double,away:double>,market_probabilities:struct<p_home:double,p_draw:double,p_away:double>,score_distribution:{_SCORE}>"
_SIDE = "struct<team_id:string,discontinuity:double,unresolved:double,usable:boolean>"
_MATCH = f"struct<match_id:string,home_team_id:string,away_team_id:string,match_date:date,kickoff_time:timestamp,stages:struct<unadjusted:{_STAGE},personnel_adjusted:{_STAGE},market_assisted:{_STAGE}>,personnel:struct<home_log_rate_shift:double,kappa:double,home:{_SIDE},away:{_SIDE}>>"
_TEAM = "struct<team_id:string,name:string,played:int,current_points:int,mean_points:double,median_points:double,mean_position:double,median_position:double,position_sd:double,mean_goal_difference:double,events:map<string,double>,points_distribution:map<string,double>,position_probabilities:array<double>,points_intervals:map<string,array<double>>,position_intervals:map<string,array<double>>>"
DOCUMENT = f"competition_id string, season_id string, model_version string, generated_at timestamp, origin_at timestamp, state_observed_at timestamp, model_results_cutoff date, matches array<{_MATCH}>, teams array<{_TEAM}>"


def _result(own: Column, other: Column, names: tuple[str, str, str] = ("W", "D", "L")) -> Column:
    """A finished match's result from one side; null before it is finished."""
    return F.when(F.col("status") == "finished", F.when(own > other, names[0]).when(own == other, names[1]).otherwise(names[2]))


def matches(data: Dataset) -> DataFrame:
    """One row per match from all providers' current rows.

    The preferred provider's row, else the newest; a finished score of another provider stands
    in for one that is not finished yet. Two sets of teams, scores or days are an error.
    """
    rows = data.current("fixtures")
    score = F.when(F.col("status") == "finished", F.struct("home_goals", "away_goals"))
    day = F.when(F.col("status") == "finished", F.col("match_date"))
    order = F.struct((F.col("provider") == "api_football").alias("first"), "retrieved_at", "provider")
    grouped = rows.groupBy("match_id").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c != "match_id"]), order).alias("row"),
        F.max(score).alias("score"),
        F.max(day).alias("day"),
        F.countDistinct(F.struct("home_team_id", "away_team_id", "competition_id", "season_id")).alias("identities"),
        F.countDistinct(score).alias("scores"),
        F.countDistinct(day).alias("days"),
    )
    clash = F.concat(F.lit("contradictory evidence of match "), F.col("match_id"))
    checked = F.when((F.col("identities") > 1) | (F.col("scores") > 1) | (F.col("days") > 1), F.raise_error(clash).cast("string")).otherwise(F.col("match_id"))
    flat = grouped.select(checked.alias("match_id"), "row.*", "score", "day")
    done = F.col("score").isNotNull()
    taken = done & (F.col("status") != "finished")
    return (
        flat.withColumn("home_goals", F.when(taken, F.col("score.home_goals")).otherwise(F.col("home_goals")))
        .withColumn("away_goals", F.when(taken, F.col("score.away_goals")).otherwise(F.col("away_goals")))
        .withColumn("match_date", F.when(taken, F.coalesce("match_date", "day")).otherwise(F.col("match_date")))
        .withColumn("status", F.when(done, "finished").otherwise(F.col("status")))
        .drop("score", "day")
    )


def team_matches(played: DataFrame) -> DataFrame:
    """Every match from both teams' side."""
    shared = ["match_id", "competition_id", "season_id", "match_date", "kickoff_time", "status", "stage"]
    side = lambda own, other: F.struct(F.col(f"{own}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.lit(own).alias("venue"), F.col(f"{own}_goals").alias("goals_for"), F.col(f"{other}_goals").alias("goals_against"))
    rows = played.select(*shared, F.inline(F.array(side("home", "away"), side("away", "home"))))
    return rows.withColumn("result", _result(F.col("goals_for"), F.col("goals_against")))


def team_match_xg(data: Dataset, played: DataFrame) -> DataFrame:
    """Matches for which both teams have an observation; a provider hands over to the later one
    from that one's first day in a competition on."""
    rows = data.current("team_process").join(played.select("match_id", "match_date", "home_team_id", "away_team_id", "home_goals", "away_goals", F.col("season_id").alias("season")), "match_id")
    first = rows.groupBy("competition_id", "provider").agg(F.min("match_date").alias("first"))
    until = first.alias("a").join(first.alias("b"), F.expr("a.competition_id = b.competition_id and (b.first > a.first or b.first = a.first and b.provider > a.provider)"), "left").groupBy("a.competition_id", "a.provider").agg(F.min("b.first").alias("until"))
    kept = rows.join(until, ["competition_id", "provider"]).filter(F.col("until").isNull() | (F.col("match_date") < F.col("until")))
    own = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(F.col("team_id") == F.col("away_team_id"), "away")
    keys = ["match_id", "season", "match_date", "home_team_id", "away_team_id", "home_goals", "away_goals"]
    sides = kept.withColumn("side", own).groupBy(*keys).agg(F.max(F.when(F.col("side") == "home", F.col("xg"))).alias("home_xg"), F.max(F.when(F.col("side") == "away", F.col("xg"))).alias("away_xg"))
    return sides.filter("home_xg is not null and away_xg is not null").withColumnRenamed("season", "season_id")


def _captured(snapshots: DataFrame, kind: str, content: DataFrame, on: dict[str, str]) -> DataFrame:
    """Snapshots of a kind with the rows of exactly that capture, or none: then one row of nulls."""
    chosen = snapshots.filter(F.col("scope_kind") == kind).alias("s")
    same = [F.col(f"c.{right}") == F.col(f"s.{left}") for left, right in {**on, "retrieved_at": "retrieved_at", "source_sha256": "source_sha256"}.items()]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return chosen.join(content.alias("c"), condition, "left")


def canonical_relations(data: Dataset) -> dict[str, DataFrame]:
    """The relations over the evidence store that ``data`` sees."""
    played, names = matches(data), data.current("players").select("player_id", F.col("name").alias("player_name"))
    newest = [F.desc("retrieved_at"), F.desc("source_sha256")]
    snapshots = latest_per_key(data.observations("source_snapshots"), ["scope_kind", "scope_key"], newest)
    availability = data.observations("availability")
    squad = _captured(snapshots, "team_squad", data.observations("memberships").filter("basis = 'captured_squad'"), {"scope_key": "team_id"})
    squad = squad.select(F.col("s.scope_key").alias("team_id"), "s.row_count", "s.retrieved_at", "s.source_sha256", "c.player_id", "c.season_id", "c.competition_id", "c.position", "c.basis")
    hurt = _captured(snapshots, "competition_injuries", availability.filter("provider = 'api_football' and scope like 'fixture:%'"), {"competition_id": "competition_id", "season_id": "season_id"})
    hurt = hurt.select("s.scope_key", "s.row_count", "s.retrieved_at", "s.source_sha256", *[f"c.{c}" for c in ("player_id", "team_id", "competition_id", "season_id", "match_id", "status", "reason", "start_date", "end_date")])
    fpl = _captured(snapshots, "fpl_availability", availability.filter("provider = 'fpl'"), {"scope_key": "season_id"})
    fpl = fpl.select(F.col("s.scope_key").alias("season_id"), "s.row_count", "s.retrieved_at", "s.source_sha256", *[f"c.{c}" for c in ("player_id", "team_id", "status", "reason", "chance_this_round", "chance_next_round", "current_round", "next_round", "news_added")])
    about = played.select("match_id", "match_date", F.col("status").alias("match_status"), "home_team_id", "away_team_id")
    teams = data.current("teams").groupBy("team_id").agg(F.max_by("name", "retrieved_at").alias("team_name"))
    return {
        "matches": played,
        "team_matches": team_matches(played),
        "team_match_xg": team_match_xg(data, played),
        "player_matches": data.observations("appearances").join(names, "player_id", "left").join(about, "match_id", "left"),
        "personnel_snapshots": snapshots,
        "squad_memberships": squad.join(names, "player_id", "left"),
        "injury_availability": hurt.join(names, "player_id", "left"),
        "fpl_availability": fpl.join(names, "player_id", "left"),
        "kalshi_snapshots": snapshots.filter("scope_kind = 'kalshi_series'"),
        "kalshi_markets": data.observations("kalshi_markets").join(teams, "team_id", "left"),
    }


def document_relations(documents: DataFrame, product: str, keys: list[str]) -> dict[str, DataFrame]:
    """The relations of season documents: ``forecast_*`` or ``hindcast_*``, keyed by ``keys``."""
    base = [*keys, "competition_id", "season_id"]
    team = documents.select(*base, F.explode("teams").alias("t"))
    named = [*base, F.col("t.team_id").alias("team_id")]
    level = lambda kind: team.select(*named, F.lit(kind).alias("estimate"), F.explode(f"t.{kind}_intervals").alias("level", "bounds"))
    intervals = level("points").unionAll(level("position"))
    scalars = [F.col(f"t.{c}").alias(c) for c in ("played", "current_points", "mean_points", "median_points", "mean_position", "median_position", "position_sd", "mean_goal_difference")]
    return {
        f"{product}_teams": team.select(*named, F.col("t.name").alias("team_name"), *scalars),
        f"{product}_team_events": team.select(*named, F.explode("t.events").alias("event", "probability")),
        f"{product}_points_distribution": team.select(*named, F.explode("t.points_distribution").alias("points", "probability")).withColumn("points", F.col("points").cast("int")),
        f"{product}_position_distribution": team.select(*named, F.posexplode("t.position_probabilities").alias("position", "probability")).withColumn("position", F.col("position") + 1),
        f"{product}_intervals": intervals.select(*base, "team_id", "estimate", F.col("level").cast("int").alias("level"), F.get("bounds", 0).alias("lower"), F.get("bounds", 1).alias("upper")),
    }


def match_relations(documents: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The relations of the match forecasts in the documents: stages, scores, market, personnel."""
    base = [*keys, "competition_id", "season_id"]
    match = documents.select(*base, F.explode("matches").alias("m")).select(*base, F.col("m.match_id").alias("match_id"), "m")
    shift = F.col("m.personnel.home_log_rate_shift")

    def stage(name: str, order: int, parent: str) -> Column:
        value = F.col(f"m.stages.{name}")
        reason = NO_QUOTE if name == "market_assisted" else NO_STAGE
        return F.struct(F.lit(name).alias("stage"), F.lit(order).alias("stage_order"), F.lit(parent).alias("parent_stage"), F.when(value.isNull(), reason).alias("availability_reason"), value.alias("v"))

    stages = match.select(*base, "match_id", shift.alias("home_log_rate_shift"), F.inline(F.array(*[stage(*s) for s in STAGES])))
    score = F.col("v.score_distribution")
    scored = stages.filter(score.isNotNull()).select(*base, "match_id", "stage", score.alias("s"))
    grid = F.col("s.grid_home_rows_away_columns")
    cells = scored.select(*base, "match_id", "stage", F.posexplode(grid).alias("home_goals", "row")).select(*base, "match_id", "stage", "home_goals", F.posexplode("row").alias("away_goals", "probability"))
    market = stages.filter("stage = 'market_assisted' and v is not null")
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"m.personnel.{name}").alias("p"))
    people = match.filter("m.personnel is not null").select(*base, "match_id", F.col("m.personnel.kappa").alias("kappa"), F.inline(F.array(side("home"), side("away"))))
    return {
        "forecast_matches": match.select(*base, "match_id", *[F.col(f"m.{c}").alias(c) for c in ("home_team_id", "away_team_id", "match_date", "kickoff_time")]),
        "forecast_match_stages": stages.select(
            *base, "match_id", "stage", "stage_order", "parent_stage", F.col("v").isNotNull().alias("available"), "availability_reason", "v.p_home", "v.p_draw", "v.p_away",
            score.home_rate.alias("home_rate"), score.away_rate.alias("away_rate"), F.col("home_log_rate_shift").isNotNull().alias("personnel_shift_available"),
            F.coalesce(F.col("home_log_rate_shift") != 0, F.lit(False)).alias("personnel_applied"), "home_log_rate_shift", "v.market_family", "v.market_observed_at", "v.market_weight",
        ),
        "forecast_score_distributions": scored.select(*base, "match_id", "stage", "s.home_rate", "s.away_rate", "s.omitted_probability", F.size(grid).alias("home_goal_values"), F.array_max(F.transform(grid, F.size)).alias("away_goal_values")),
        "forecast_score_grid": cells,
        "forecast_market_inputs": market.select(
            *base, "match_id", "v.market_family", "v.market_observed_at", F.col("v.decimal_odds.home").alias("home_odds"), F.col("v.decimal_odds.draw").alias("draw_odds"), F.col("v.decimal_odds.away").alias("away_odds"),
            F.col("v.market_probabilities.p_home").alias("market_p_home"), F.col("v.market_probabilities.p_draw").alias("market_p_draw"), F.col("v.market_probabilities.p_away").alias("market_p_away"), "v.raw_implied_probability_sum", "v.market_weight",
        ),
        "forecast_personnel_teams": people.select(*base, "match_id", "kappa", "side", "p.team_id", "p.discontinuity", "p.unresolved", "p.usable"),
    }


def derived_relations(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Views over the relations of live forecasts and hindcasts."""
    keys = ["forecast_id", "competition_id", "season_id"]
    out = {}
    if "forecast_match_stages" in found:
        rows, on = found["forecast_match_stages"], [*keys, "match_id"]
        wide = rows.groupBy(*on).agg(F.bool_or("personnel_applied").alias("personnel_applied"), F.max("home_log_rate_shift").alias("home_log_rate_shift"), *[F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}") for s, _, _ in STAGES for c in ("p_home", "p_draw", "p_away", "home_rate", "away_rate") if not (s == "market_assisted" and c.endswith("rate"))])
        people = found["forecast_personnel_teams"]
        gaps = pivot_stages(people, on, "side", "discontinuity", ["home", "away"]).withColumnsRenamed({"home": "D_home", "away": "D_away"})
        kappa = people.groupBy(*on).agg(F.max("kappa").alias("kappa"))
        out["forecast_match_stage_comparison"] = wide.join(gaps.join(kappa, on), on, "left")
    if "forecasts" in found and "hindcast_origins" in found:
        live = found["forecasts"].select(*keys, F.col("public_model_version").alias("model_version"), "generated_at", "state_observed_at", "model_results_cutoff")
        past_keys = ["hindcast_id", "competition_id", "season_id"]
        past = found["hindcast_origins"]
        label = lambda df, name, other: df.withColumns({"product": F.lit(name), "retrospective": F.lit(name == "hindcast"), other: F.lit(None).cast("string")})
        both = lambda suffix: label(found[f"forecast_{suffix}"].join(live, keys), "live", "hindcast_id").unionByName(label(found[f"hindcast_{suffix}"].join(past, past_keys), "hindcast", "forecast_id"), allowMissingColumns=True)
        out["team_projections"] = both("teams")
        events = both("team_events").withColumn("observed_at", F.when(F.col("retrospective"), F.col("origin_at")).otherwise(F.col("generated_at")))
        team = lambda suffix: found[f"{suffix}_teams"]
        # An id may be used by both products, so the product is part of the key.
        names = team("forecast").select(F.lit("live").alias("product"), F.col("forecast_id").alias("id"), "competition_id", "season_id", "team_id", "team_name").unionAll(team("hindcast").select(F.lit("hindcast"), "hindcast_id", "competition_id", "season_id", "team_id", "team_name"))
        out["team_event_probabilities"] = events.withColumn("id", F.coalesce("forecast_id", "hindcast_id")).join(names, ["product", "id", "competition_id", "season_id", "team_id"]).drop("id")
    if "match_hindcasts" in found and "matches" in found:
        played = found["matches"].select("match_id", "status", "home_goals", "away_goals")
        out["match_hindcast_outcomes"] = found["match_hindcasts"].join(played, "match_id", "left").withColumn("outcome", _result(F.col("home_goals"), F.col("away_goals"), ("H", "D", "A")))
    return out


# Field names of simulations, impacts, match hindcasts and records.
_SIM_TEAM = _TEAM[:-1] + ",goal_difference_distribution:map<string,double>,conditional_europe_probabilities:map<string,double>,event_probabilities:map<string,double>>"
SIMULATION = f"simulations int, seed bigint, as_of date, results_observed_at timestamp, played_matches int, remaining_matches int, head_to_head_applied_rate double, unresolved_decisive_tie_rate double, ranking_rules string, point_adjustments string, assumptions string, playoff_model string, europe_scenario string, teams array<{_SIM_TEAM}>, match_frequencies map<string,struct<p_home:double,p_draw:double,p_away:double>>"
_BLOCK = "struct<team_id:array<string>,baseline:array<double>,home:array<double>,draw:array<double>,away:array<double>,rms_movement:array<double>>"
IMPACT = f"horizon_days int, window_start timestamp, window_end timestamp, coverage string, minimum_conditional_samples int, fixtures array<struct<match_id:string,match_date:date,kickoff_time:timestamp,home_team_id:string,away_team_id:string,status:string,outcome:string,sufficient_sample:boolean,max_standard_error:double,top_rms_movement:double,unavailable_reason:string,outcome_counts:struct<home:bigint,draw:bigint,away:bigint>,carried_from:struct<forecast_id:string,generated_at:timestamp>,impacts:map<string,{_BLOCK}>>>"
_PLAYER = "struct<player_id:string,player_name:string,recent_weight:double,membership:string,recent_squads:int,in_last_squad:boolean,availability:string,probability:double,membership_basis:array<string>,membership_conflicts:array<string>,availability_basis:array<string>>"
PERSONNEL = f"match_id string, home_log_rate_shift double, kappa double, sides array<struct<side:string,team_id:string,discontinuity:double,unresolved_weight:double,unusable_reason:string,reference_matches:array<string>,players:array<{_PLAYER}>>>"
HINDCAST = f"model_version string, competition_id string, season_id string, prospective_from date, matches array<struct<match_id:string,match_date:date,kickoff_time:timestamp,home_team_id:string,away_team_id:string,origin_at:timestamp,model_results_cutoff:date,p_home:double,p_draw:double,p_away:double,unadjusted:struct<p_home:double,p_draw:double,p_away:double>,personnel:struct<home_discontinuity:double,away_discontinuity:double,home_log_rate_shift:double>,score_probabilities:{_SCORE}>>"
_RECORDED = "array<struct<match_id:string,competition_id:string,season_id:string,forecast_id:string,generated_at:timestamp,kickoff_time:timestamp,model_version:string,p_home:double,p_draw:double,p_away:double,outcome:string>>"
RECORD = f"pending {_RECORDED}, settled {_RECORDED}, summary map<string,struct<scored:bigint,log_loss:double,brier:double,classwise_ece:double>>"


# Field names of model runs.
_STATE_FIELDS = "quality tilt quality_sd tilt_sd quality_tilt_covariance quality_level quality_form quality_level_sd quality_form_sd quality_level_form_covariance attack_log_rate defense_log_rate attack_sd defense_sd attack_multiplier defense_multiplier".split()
_SPECIFICATION_FIELDS = "quality_retention quality_sd form_retention form_sd tilt_retention tilt_sd dispersion chance_probability prior_weight posterior_weight log_evidence".split()
_SPECIFICATION = "struct<" + ",".join(f"{c}:double" for c in _SPECIFICATION_FIELDS) + ">"
_STATE = "struct<team_id:string," + ",".join(f"{c}:double" for c in _STATE_FIELDS) + ",training_matches:int,state_source:string,season_matches:int>"
RUN = f"competition_id string, season_id string, generated_at timestamp, model_id string, model_version string, package_version string, code_sha256 string, training_matches int, training_date_max date, league_away_goal_rate double, home_scoring_multiplier double, personnel struct<kappa:double,horizon_days:int,records:int,adjusted_fixtures:int,persistent_state_changed:boolean>, team_strengths array<{_STATE}>, fit_diagnostics struct<specifications:array<{_SPECIFICATION}>>"


def run_relations(runs: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Model runs, the team states they ended with, and the specifications they weighed.

    The columns are those of ``RUN`` beside ``keys``. A rate or multiplier that is not
    positive has no logarithm.
    """
    base = [*keys, "competition_id", "season_id"]
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    plain = [c for c in ("generated_at", "model_id", "model_version", "package_version", "code_sha256", "training_matches", "training_date_max", "league_away_goal_rate", "home_scoring_multiplier")]
    people = [F.col(f"personnel.{c}").alias(n) for c, n in (("kappa", "personnel_kappa"), ("horizon_days", "personnel_horizon_days"), ("records", "personnel_records"), ("adjusted_fixtures", "personnel_adjusted_fixtures"), ("persistent_state_changed", "persistent_state_changed"))]
    return {
        "forecast_runs": runs.select(*base, *plain, log("league_away_goal_rate").alias("league_log_rate"), log("home_scoring_multiplier").alias("home_advantage_log"), *people, F.to_json("fit_diagnostics").alias("fit_diagnostics")),
        "model_team_states": runs.select(*base, F.explode("team_strengths").alias("t")).select(*base, "t.*", F.to_json("t").alias("state")),
        "model_specifications": runs.select(*base, F.posexplode("fit_diagnostics.specifications").alias("specification_index", "s")).select(*base, "specification_index", "s.*"),
    }


def session_relation(data: Dataset, loaded_at: str) -> DataFrame:
    """One row: when the session was opened, its cutoff, and how many batches it sees."""
    rows = [(loaded_at, data.cutoff.isoformat() if data.cutoff else None, len(data.manifests))]
    return data.spark.createDataFrame(rows, "loaded_at string, cutoff string, batches int")


def simulation_relations(runs: DataFrame, product: str, keys: list[str]) -> dict[str, DataFrame]:
    """The nine relations of simulations (``keys`` beside the columns of ``SIMULATION``)."""
    name = f"{product}_simulation"
    team = runs.select(*keys, F.explode("teams").alias("t"))
    named = [*keys, F.col("t.team_id").alias("team_id")]
    scalars = [F.col(f"t.{c}").alias(c) for c in ("played", "current_points", "mean_points", "median_points", "mean_position", "median_position", "position_sd", "mean_goal_difference")]
    counted = lambda field, key: team.select(*named, F.explode(f"t.{field}").alias(key, "probability")).withColumn(key, F.col(key).cast("int"))
    level = lambda kind: team.select(*named, F.lit(kind).alias("estimate"), F.explode(f"t.{kind}_intervals").alias("level", "bounds"))
    intervals = level("points").unionAll(level("position"))
    flat = [c for c in runs.columns if c not in ("teams", "match_frequencies")]
    return {
        f"{name}_runs": runs.select(*flat),
        f"{name}_teams": team.select(*named, F.col("t.name").alias("team_name"), *scalars),
        f"{name}_team_events": team.select(*named, F.explode("t.event_probabilities").alias("event", "probability")),
        f"{name}_points_distribution": counted("points_distribution", "points"),
        f"{name}_position_distribution": team.select(*named, F.posexplode("t.position_probabilities").alias("position", "probability")).withColumn("position", F.col("position") + 1),
        f"{name}_goal_difference_distribution": counted("goal_difference_distribution", "goal_difference"),
        f"{name}_intervals": intervals.select(*keys, "team_id", "estimate", F.col("level").cast("int").alias("level"), F.get("bounds", 0).alias("lower"), F.get("bounds", 1).alias("upper")),
        f"{name}_europe_probabilities": team.select(*named, F.explode("t.conditional_europe_probabilities").alias("scenario", "probability")),
        f"{name}_match_frequencies": runs.select(*keys, F.explode("match_frequencies").alias("match_id", "f")).select(*keys, "match_id", "f.*"),
    }


def impact_relations(impacts: DataFrame, keys: list[str], baselines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fixtures and, per event, team and outcome, what an outcome does. A baseline that the
    block leaves out is the team's own event probability."""
    fixture = impacts.select(*keys, "horizon_days", "window_start", "window_end", "coverage", "minimum_conditional_samples", F.explode("fixtures").alias("f"))
    carried = [F.col("f.carried_from.forecast_id").alias("carried_from_forecast_id"), F.col("f.carried_from.generated_at").alias("carried_from_generated_at")]
    plain = [F.col(f"f.{c}").alias(c) for c in ("match_id", "match_date", "kickoff_time", "home_team_id", "away_team_id", "status", "outcome", "sufficient_sample", "max_standard_error", "top_rms_movement", "unavailable_reason")]
    counts = [F.col(f"f.outcome_counts.{o}").alias(f"outcome_count_{o}") for o in ("home", "draw", "away")]
    about = [F.col(c).alias(n) for c, n in (("horizon_days", "impact_horizon_days"), ("window_start", "impact_window_start"), ("window_end", "impact_window_end"), ("coverage", "impact_coverage"), ("minimum_conditional_samples", "minimum_conditional_samples"))]
    block = fixture.select(*keys, F.col("f.match_id").alias("match_id"), *carried, F.explode("f.impacts").alias("event", "b"))
    row = block.select(*keys, "match_id", "carried_from_forecast_id", "carried_from_generated_at", "event", "b", F.posexplode("b.team_id").alias("i", "team_id"))
    outcome = lambda o: F.struct(F.lit(o).alias("outcome"), F.get(f"b.{o}", F.col("i")).alias("conditional_probability"))
    long = row.select(*keys, "match_id", "event", "team_id", F.get("b.baseline", F.col("i")).alias("baseline"), F.get("b.rms_movement", F.col("i")).alias("rms_movement"), "carried_from_forecast_id", "carried_from_generated_at", F.inline(F.array(*map(outcome, ("home", "draw", "away")))))
    if baselines is not None:
        own = baselines.select(*keys, "team_id", "event", F.col("probability").alias("_own"))
        long = long.join(own, [*keys, "team_id", "event"], "left").withColumn("baseline", F.coalesce("baseline", "_own")).drop("_own")
    return {"forecast_impact_fixtures": fixture.select(*keys, *plain, *counts, *carried, *about), "forecast_impacts": long}


def personnel_relations(records: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Teams, players, reference matches and evidence behind the personnel adjustment."""
    base = [*keys, "match_id"]
    shift = F.col("home_log_rate_shift")
    other = F.exists("sides", lambda x: (x["side"] != F.col("s.side")) & x["unusable_reason"].isNotNull())
    side = records.select(*base, "home_log_rate_shift", "kappa", "sides", F.explode("sides").alias("s"))
    status = F.when(shift.isNotNull(), F.when(shift != 0, APPLIED).otherwise(NEUTRAL)).when(F.col("s.unusable_reason").isNotNull(), F.col("s.unusable_reason")).when(other, OTHER_TEAM).otherwise(NO_SHIFT)
    named = [*base, F.col("s.team_id").alias("team_id"), F.col("s.side").alias("side")]
    teams = side.select(
        *named, "s.discontinuity", "s.unresolved_weight", F.col("s.unusable_reason").isNull().alias("usable_for_shift"), "kappa", "home_log_rate_shift",
        F.when(F.col("s.side") == "home", shift).otherwise(-shift).alias("team_log_rate_shift"), F.coalesce(shift != 0, F.lit(False)).alias("personnel_applied"), status.alias("status"),
    )
    player = side.select(*named, F.col("s.unresolved_weight").alias("unresolved"), F.explode("s.players").alias("p"))
    expected = F.col("p.recent_weight") * (1 - F.col("p.probability"))
    kinds = ("membership_basis", "membership_conflicts", "availability_basis")
    evidence = F.array(*[F.struct(F.lit(k).alias("evidence_kind"), F.col(f"p.{k}").alias("items")) for k in kinds])
    facts = player.select(*base, "team_id", "side", F.col("p.player_id").alias("player_id"), F.inline(evidence))
    return {
        "forecast_personnel_teams": teams,
        "forecast_personnel_players": player.select(
            *base, "team_id", "side", "p.player_id", "p.player_name", "p.recent_weight", "p.membership", "p.recent_squads", "p.in_last_squad", "p.availability", F.col("p.probability").alias("selection_probability"),
            *[f"p.{k}" for k in kinds], expected.alias("expected_missing_weight"), F.when(F.col("unresolved") < 1, expected / (1 - F.col("unresolved"))).alias("discontinuity_contribution"),
        ),
        "forecast_personnel_evidence": facts.select(*base, "team_id", "side", "player_id", "evidence_kind", F.posexplode("items").alias("ordinal", "basis")).withColumn("ordinal", F.col("ordinal") + 1),
        "forecast_personnel_reference_matches": side.select(*named, F.explode("s.reference_matches").alias("reference_match_id")),
    }


def match_hindcast_relations(documents: DataFrame) -> dict[str, DataFrame]:
    """Retrospective match forecasts and their score grids."""
    base = ["model_version", "competition_id", "season_id"]
    match = documents.select(*base, "prospective_from", F.explode("matches").alias("m"))
    score = "m.score_probabilities"
    plain = ("match_id", "match_date", "kickoff_time", "home_team_id", "away_team_id", "origin_at", "model_results_cutoff", "p_home", "p_draw", "p_away")
    rows = match.select(
        *base, F.lit(True).alias("retrospective"), "prospective_from", *[f"m.{c}" for c in plain], *[F.col(f"m.unadjusted.{c}").alias(f"unadjusted_{c}") for c in ("p_home", "p_draw", "p_away")],
        F.col("m.personnel.home_log_rate_shift").isNotNull().alias("personnel_applied"), "m.personnel.home_discontinuity", "m.personnel.away_discontinuity", "m.personnel.home_log_rate_shift", f"{score}.home_rate", f"{score}.away_rate", f"{score}.omitted_probability",
    )
    lines = match.select(*base, F.col("m.match_id").alias("match_id"), F.posexplode(f"{score}.grid_home_rows_away_columns").alias("home_goals", "line"))
    return {"match_hindcasts": rows, "match_hindcast_score_grid": lines.select(*base, "match_id", "home_goals", F.posexplode("line").alias("away_goals", "probability"))}


def record_relations(record: DataFrame) -> dict[str, DataFrame]:
    """The prospective record: its matches, pending and settled, and its summaries by scope."""
    states = F.array(*[F.struct(F.lit(s).alias("record_state"), F.col(s).alias("rows")) for s in ("pending", "settled")])
    rows = record.select(F.inline(states)).select("record_state", F.inline("rows"))
    return {"record_matches": rows, "record_summary": record.select(F.explode("summary").alias("scope", "v")).select("scope", "v.*", F.to_json("v").alias("metrics"))}


# What one row of a relation is.
GRAINS = {
    "matches": "match", "team_matches": "match and team", "team_match_xg": "match", "player_matches": "match, player, team and capture", "personnel_snapshots": "scope", "squad_memberships": "scope and player, or none",
    "injury_availability": "scope and player, or none", "fpl_availability": "scope and player, or none", "kalshi_snapshots": "scope", "kalshi_markets": "ticker and capture",
    "forecast_matches": "forecast and match", "forecast_match_stages": "forecast, match and stage", "forecast_score_distributions": "forecast, match and stage", "forecast_score_grid": "forecast, match, stage and score",
    "forecast_market_inputs": "forecast and match", "forecast_personnel_teams": "forecast, match and team", "forecast_match_stage_comparison": "forecast and match", "team_projections": "product, origin and team",
    "team_event_probabilities": "product, origin, team and event", "match_hindcast_outcomes": "match hindcast", "session": "session", "forecast_runs": "forecast", "model_team_states": "forecast and team",
    "model_specifications": "forecast and specification", "match_hindcasts": "version and match", "match_hindcast_score_grid": "version, match and score", "record_matches": "state and match", "record_summary": "scope",
}
PRIVATE = {"player_matches", "personnel_snapshots", "squad_memberships", "injury_availability", "fpl_availability"}


def open_namespace(
    data: Dataset,
    forecasts: DataFrame | None = None,
    hindcasts: DataFrame | None = None,
    prefix: str = "analysis_",
    runs: DataFrame | None = None,
    simulations: dict[str, DataFrame] | None = None,
    impacts: DataFrame | None = None,
    personnel: DataFrame | None = None,
    match_hindcasts: DataFrame | None = None,
    record: DataFrame | None = None,
) -> Namespace:
    """The namespace over a dataset and, where given, the documents of forecasts and hindcasts,
    model runs, simulations (by product: forecast, hindcast), impacts, personnel records,
    match hindcasts and the prospective record.

    Documents have an id column (forecast_id, hindcast_id) beside those of their schema here.
    """
    found = canonical_relations(data)
    key = {"forecast": ["forecast_id", "competition_id", "season_id"], "hindcast": ["hindcast_id", "competition_id", "season_id"]}
    if forecasts is not None:
        found["forecasts"] = forecasts.select("forecast_id", "competition_id", "season_id", F.col("model_version").alias("public_model_version"), "generated_at", "state_observed_at", "model_results_cutoff")
        found |= document_relations(forecasts, "forecast", ["forecast_id"]) | match_relations(forecasts, ["forecast_id"])
    if hindcasts is not None:
        found["hindcast_origins"] = hindcasts.select("hindcast_id", "competition_id", "season_id", "model_version", "generated_at", "origin_at", "model_results_cutoff")
        found |= document_relations(hindcasts, "hindcast", ["hindcast_id"])
    if runs is not None:
        found |= run_relations(runs, ["forecast_id"])
    for product, documents in (simulations or {}).items():
        found |= simulation_relations(documents, product, key[product])
    if impacts is not None:
        found |= impact_relations(impacts, key["forecast"], found.get("forecast_team_events"))
    if match_hindcasts is not None:
        found |= match_hindcast_relations(match_hindcasts)
    if record is not None:
        found |= record_relations(record)
    found |= derived_relations(found)
    if personnel is not None:  # the full records stand in for what the documents say of teams
        found |= personnel_relations(personnel, key["forecast"])
    found["session"] = session_relation(data, datetime.now(timezone.utc).isoformat())
    return Namespace(data.spark, [Relation(n, GRAINS.get(n, n.replace("_", " ")), f"{n.replace('_', ' ').capitalize()}.", df, private=n in PRIVATE) for n, df in found.items()], prefix)
