"""Who is likely to be missing: the discontinuity of a team's matchday squad before a fixture.

Everything is joins and grouped sums over keys of match, team and player; no step sees more
than one team's recent matches at once. Rows are what was retrieved by the cutoff.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.columns import local_day
from fieldbook.operators.relops import latest_per_key

# The window of matches, minutes, squad sizes, limits, statuses, the coefficient,
# and the share of members in the next squad by squads in the window and inclusion in the last.
MATCHES = 8
MINUTES = 90
FULL_MINUTES = 700
STARTERS = 11
LEAST_BENCH = 7
MOST_UNRESOLVED = 0.25
DOUBTFUL = 0.3
KAPPA = 0.43161578781583126
HORIZON_DAYS = 6
FPL_COMPETITION = "eng-premier-league"
FPL_STATUS = {"a": 1.0, "d": DOUBTFUL, "i": 0.0, "s": 0.0, "n": 0.0, "u": 0.0}
API_STATUS = {"unavailable": 0.0, "doubtful": DOUBTFUL}
PROPENSITY = {
    (1, False): 0.29692214846107423, (1, True): 0.9173838209982789,
    (2, False): 0.3450737743931461, (2, True): 0.9107398568019093,
    (3, False): 0.39690721649484534, (3, True): 0.9088026855650877,
    (4, False): 0.4024691358024691, (4, True): 0.9071785819358635,
    (5, False): 0.4737704918032787, (5, True): 0.9141130772550712,
    (6, False): 0.5219683655536028, (6, True): 0.923648015004689,
    (7, False): 0.6280834914611005, (7, True): 0.9391924196983527,
    (8, True): 0.9586164696789153,
}

CAPTURE = ["retrieved_at", "source_sha256"]
SIDE = ["match_id", "team_id"]


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _captures(appearances: DataFrame) -> DataFrame:
    """Each capture of a team in a match that names one kick-off."""
    grouped = appearances.filter("kickoff_time is not null").groupBy(*SIDE, *CAPTURE)
    found = grouped.agg(F.min("kickoff_time").alias("kickoff"), F.max("kickoff_time").alias("last_kickoff"), F.count("minutes").alias("recorded"), F.count_if(F.col("starts") == 1).alias("starters"), F.count("*").alias("named"))
    return found.filter("kickoff = last_kickoff")


def matchday_squads(appearances: DataFrame, cutoff: datetime) -> DataFrame:
    """The rows of the one capture that counts of each team's finished match: the newest with
    minutes. A later capture replaces an earlier one as a whole; one without minutes does not."""
    usable = _captures(appearances).filter((F.col("kickoff") < F.lit(cutoff)) & (F.col("recorded") > 0))
    chosen = latest_per_key(usable.select(*SIDE, *CAPTURE), SIDE, [F.desc(c) for c in CAPTURE])
    return appearances.join(chosen, [*SIDE, *CAPTURE])


def team_sheets(appearances: DataFrame) -> DataFrame:
    """(match_id, team_id, player_id, sheet_at): the newest capture before kick-off that names a
    whole squad, eleven starters and a full bench."""
    whole = (F.col("starters") == STARTERS) & (F.col("named") - F.col("starters") >= LEAST_BENCH)
    sheets = _captures(appearances).filter((F.col("retrieved_at") < F.col("kickoff")) & whole)
    chosen = latest_per_key(sheets.select(*SIDE, *CAPTURE), SIDE, [F.desc(c) for c in CAPTURE])
    return appearances.join(chosen, [*SIDE, *CAPTURE]).select(*SIDE, "player_id", F.col("retrieved_at").alias("sheet_at"))


def reference_matches(sides: DataFrame, finished: DataFrame, cutoff: datetime) -> DataFrame:
    """(match_id, team_id, reference, place): a team's last matches known at the cutoff and dated
    before the fixture; place 1 is the last.

    sides: match_id, team_id, match_date; finished: match_id, match_date, kickoff_time,
    home_team_id, away_team_id. Without a kick-off a match is known the London day after.
    """
    after = F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), F.date_add("match_date", 1).cast("timestamp_ntz")).cast("timestamp")
    past = finished.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), F.col("match_id").alias("reference"), F.col("match_date").alias("day"), F.coalesce("kickoff_time", after).alias("known_at"))
    known = sides.join(past, "team_id").filter((F.col("day") < F.col("match_date")) & (F.col("known_at") < F.lit(cutoff)))
    newest = Window.partitionBy(*SIDE).orderBy(F.desc("day"), F.desc("reference"))
    return known.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= MATCHES).select(*SIDE, "reference", "place")


def recent_weights(references: DataFrame, squads: DataFrame) -> DataFrame:
    """(match_id, team_id, player_id, weight, squads, in_last) of the teams whose last matches
    are all recorded in full; weight is in minutes, of which a match counts 90 at most."""
    rows = squads.select(F.col("match_id").alias("reference"), "team_id", "player_id", F.when(F.col("minutes").isNotNull(), F.least("minutes", F.lit(MINUTES))).alias("played"))
    joined = references.join(rows, ["reference", "team_id"])
    full = joined.groupBy(*SIDE, "reference").agg(F.sum("played").alias("total")).filter(F.col("total") >= FULL_MINUTES)
    complete = full.groupBy(*SIDE).agg(F.count("*").alias("full")).filter(F.col("full") == MATCHES).select(*SIDE)
    players = joined.join(complete, SIDE, "left_semi").groupBy(*SIDE, "player_id")
    return players.agg(F.sum("played").alias("weight"), F.count("*").alias("squads"), F.bool_or(F.col("place") == 1).alias("in_last")).filter("weight is not null")


def memberships(pairs: DataFrame, spells: DataFrame, transfers: DataFrame, squads: DataFrame, fpl: DataFrame, day, none_known: bool) -> DataFrame:
    """(player_id, team_id, membership) of each pair: member, departed or unknown.

    Dated evidence after the last appearance for the team decides: a transfer, or a matchday
    squad of another team. Of one day's evidence that disagrees none wins. Without any, the
    newest squads and FPL teams decide if they agree. spells: player_id, team_id, match_date;
    squads and fpl: player_id, team_id. ``none_known`` says that no squad or FPL list exists,
    which leaves a player a member.
    """
    keys = ["player_id", "team_id"]
    own = pairs.join(spells.groupBy(*keys).agg(F.max("match_date").alias("since")), keys, "left")
    fresh = lambda when: F.col("since").isNull() | (when > F.col("since"))
    leaves = F.col("from_team_id").eqNullSafe(F.col("team_id"))
    joins = F.col("to_team_id").eqNullSafe(F.col("team_id"))
    moves = own.join(transfers.filter(F.col("transfer_date") <= day).select("player_id", F.col("transfer_date").alias("on"), "from_team_id", "to_team_id"), "player_id")
    moves = moves.filter(fresh(F.col("on")) & (leaves != joins)).select(*keys, "on", F.when(joins, "member").otherwise("departed").alias("state"))
    elsewhere = own.join(spells.select("player_id", F.col("team_id").alias("other"), F.col("match_date").alias("on")).distinct(), "player_id")
    elsewhere = elsewhere.filter((F.col("other") != F.col("team_id")) & fresh(F.col("on"))).select(*keys, "on", F.lit("departed").alias("state"))
    days = moves.unionByName(elsewhere).groupBy(*keys, "on").agg(F.min("state").alias("low"), F.max("state").alias("high"))
    strong = latest_per_key(days, keys, [F.desc("on")]).select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("unknown").alias("dated"))
    lists = squads.select("player_id", F.col("team_id").alias("listed")).unionByName(fpl.select("player_id", F.col("team_id").alias("listed")))
    same = F.col("listed").eqNullSafe(F.col("team_id"))
    weak = pairs.join(lists, "player_id").groupBy(*keys).agg(F.bool_or(same).alias("in"), F.bool_or(~same).alias("out"))
    rows = pairs.join(strong, keys, "left").join(weak, keys, "left")
    listed = F.when(F.col("in") & ~F.col("out"), "member").when(F.col("out") & ~F.col("in"), "departed").when(F.col("in") & F.col("out"), "unknown")
    return rows.select(*keys, F.coalesce("dated", listed, F.lit("member" if none_known else "unknown")).alias("membership"))


def availability(rows: DataFrame, injuries: DataFrame, fpl: DataFrame) -> DataFrame:
    """``rows`` with availability: 1 where nothing is reported, null where a status is not known.

    rows: match_id, team_id, player_id, competition_id. FPL goes first in its competition, if
    it lists the player with the team; else the lowest of the fixture's reports decides.
    """
    keys = [*SIDE, "player_id"]
    value = _lookup(API_STATUS, F.col("status"))
    reports = injuries.groupBy(*keys).agg(F.min(value).alias("least"), F.bool_or(value.isNull()).alias("unclear"))
    listed = fpl.select("player_id", "team_id", F.col("status").alias("fpl_status")).withColumn("listed", F.lit(True))
    found = rows.join(reports, keys, "left").join(listed, ["player_id", "team_id"], "left")
    by_fpl = (F.col("competition_id") == FPL_COMPETITION) & F.col("listed")
    reported = F.when(F.col("unclear"), F.lit(None)).otherwise(F.coalesce("least", F.lit(1.0)))
    return found.withColumn("availability", F.when(by_fpl, _lookup(FPL_STATUS, F.col("fpl_status"))).otherwise(reported)).drop("least", "unclear", "fpl_status", "listed")


def player_probabilities(weights: DataFrame, members: DataFrame, sheets: DataFrame) -> DataFrame:
    """``weights`` (with availability) with membership and the probability of being in the squad.

    A whole team sheet says it outright. Else one who has left is out, a member is in with
    the availability times the share for his record, and the rest is not known.
    """
    official = sheets.select(*SIDE).distinct().withColumn("official", F.lit(True))
    named = sheets.select(*SIDE, "player_id").withColumn("named", F.lit(True))
    rows = weights.join(members, ["player_id", "team_id"], "left").join(official, SIDE, "left").join(named, [*SIDE, "player_id"], "left")
    record = F.concat_ws(":", F.col("squads").cast("string"), F.col("in_last").cast("string"))
    share = _lookup({f"{n}:{str(last).lower()}": p for (n, last), p in PROPENSITY.items()}, record)
    p = F.when(F.col("official"), F.coalesce(F.col("named"), F.lit(False)).cast("double")).when(F.col("membership") == "departed", 0.0).when(F.col("membership") == "member", F.col("availability") * share)
    return rows.withColumn("probability", p).drop("official", "named")


def team_continuity(sides: DataFrame, players: DataFrame) -> DataFrame:
    """``sides`` with discontinuity, unresolved_weight and unusable_reason: the share of recent
    minutes that is expected to be missing, of those whose players are resolved."""
    known = F.col("probability").isNotNull()
    sums = players.groupBy(*SIDE).agg(F.sum("weight").alias("total"), F.sum(F.when(known, F.col("weight")).otherwise(0)).alias("resolved"), F.sum(F.col("weight") * F.col("probability")).alias("represented"))
    rows = sides.join(sums, SIDE, "left").withColumns({"discontinuity": F.when(F.col("resolved") > 0, 1 - F.col("represented") / F.col("resolved")), "unresolved_weight": 1 - F.col("resolved") / F.col("total")})
    reason = F.when(F.col("discontinuity").isNull(), "discontinuity_unavailable").when(F.col("unresolved_weight") > MOST_UNRESOLVED, "unresolved_weight_too_high")
    return rows.withColumn("unusable_reason", reason).drop("total", "resolved", "represented")


def shifts(teams: DataFrame) -> DataFrame:
    """(match_id, home_log_rate_shift) of the fixtures; null unless both teams are usable."""
    side = lambda name: F.max(F.when((F.col("side") == name) & F.col("unusable_reason").isNull(), F.col("discontinuity")))
    return teams.groupBy("match_id").agg((KAPPA * (side("away") - side("home"))).alias("home_log_rate_shift"))


def personnel(fixtures: DataFrame, finished: DataFrame, appearances: DataFrame, transfers: DataFrame, squads: DataFrame, fpl: DataFrame, injuries: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(teams, players, shifts) of the fixtures that kick off within the horizon.

    fixtures: match_id, competition_id, match_date, kickoff_time, home_team_id, away_team_id;
    squads, fpl and injuries are the rows of the newest captures, the others all observations.
    """
    appearances, transfers = (df.filter(F.col("retrieved_at") <= F.lit(cutoff)) for df in (appearances, transfers))
    near = fixtures.filter((F.col("kickoff_time") > F.lit(cutoff)) & (F.col("kickoff_time") <= F.lit(cutoff) + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS")))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_team_id").alias("team_id"))
    sides = near.select("match_id", "competition_id", "match_date", F.inline(F.array(side("home"), side("away"))))
    chosen = matchday_squads(appearances, cutoff)
    weights = recent_weights(reference_matches(sides.select(*SIDE, "match_date"), finished, cutoff), chosen)
    day = local_day(F.lit(cutoff).cast("timestamp_ntz"))
    none_known = squads.isEmpty() and fpl.isEmpty()
    spells = chosen.select("player_id", "team_id", "match_date").distinct()
    members = memberships(weights.select("player_id", "team_id").distinct(), spells, transfers, squads.filter("player_id is not null"), fpl.filter("player_id is not null"), day, none_known)
    rows = availability(weights.join(sides.select(*SIDE, "competition_id"), SIDE), injuries, fpl)
    players = player_probabilities(rows, members, team_sheets(appearances))
    teams = team_continuity(sides, players)
    return teams, players, shifts(teams)
