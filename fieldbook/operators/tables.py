"""League tables, tie-breaks, distributions and conditional impacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators.relops import two_sided
from fieldbook.operators.simulate import european_places


def sides(matches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, match_id, venue, team, opponent, gf, ga): every match from both sides."""
    return two_sided(matches, [*keys, "match_id"], {"team": "home", "opponent": "away", "gf": "home_goals", "ga": "away_goals"}, {"team": "away", "opponent": "home", "gf": "away_goals", "ga": "home_goals"})


def _points():
    return F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0).cast("long")


def league_table(matches: DataFrame, sanctions: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, team, played, points, gd, gf), with known point adjustments (keys, team, adjustment).

    A table for each value of ``keys``, such as competition and season. Adjustments apply to
    their own keys only; several of one team are added up.
    """
    table = sides(matches, keys).groupBy(*keys, "team").agg(F.count("*").alias("played"), F.sum(_points()).alias("points"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf"))
    if sanctions is not None:
        own = sanctions.groupBy(*keys, "team").agg(F.sum("adjustment").alias("adjustment"))
        table = table.join(own, [*keys, "team"], "left").withColumn("points", F.col("points") + F.coalesce("adjustment", F.lit(0))).drop("adjustment")
    return table


def head_to_head(matches: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, team, h2h_points, h2h_gd, h2h_goals, h2h_away_goals) over matches within a tie
    group (keys, team, tie) of the same keys."""
    own = groups.select(*keys, "team", F.col("tie").alias("own_tie"))
    other = groups.select(*keys, F.col("team").alias("opponent"), F.col("tie").alias("other_tie"))
    inside = sides(matches, keys).join(own, [*keys, "team"]).join(other, [*keys, "opponent"]).filter("own_tie = other_tie")
    return inside.groupBy(*keys, "team").agg(
        F.sum(_points()).alias("h2h_points"),
        F.sum(F.col("gf") - F.col("ga")).alias("h2h_gd"),
        F.sum("gf").alias("h2h_goals"),
        F.sum(F.when(F.col("venue") == "away", F.col("gf")).otherwise(0)).alias("h2h_away_goals"),
    )


def position_mass(table: DataFrame, keys: Sequence[str], order: Sequence[str], team: str = "team") -> DataFrame:
    """(keys, team, position, mass): teams that tie on the order share its positions equally."""
    ranked = table.withColumn("_first", F.rank().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    tied = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, *order)))
    spread = tied.withColumn("position", F.explode(F.sequence(F.col("_first"), (F.col("_first") + F.col("_n") - 1).cast("int"))))
    return spread.select(*keys, team, "position", (F.lit(1.0) / F.col("_n")).alias("mass"))


def conditional_means(paths: DataFrame, keys: Sequence[str], outcome: str, indicator: str) -> DataFrame:
    """(keys, outcome, n, conditional, standard_error): the indicator's mean given each outcome."""
    grouped = paths.groupBy(*keys, outcome).agg(F.count("*").alias("n"), F.avg(indicator).alias("conditional"), F.var_pop(indicator).alias("v"))
    return grouped.withColumn("standard_error", F.sqrt(F.col("v") / F.col("n"))).drop("v")


def impact_summary(means: DataFrame, keys: Sequence[str], unconditional: DataFrame) -> DataFrame:
    """(keys, baseline, rms, swing, recovered) of the conditional means; rms weighs outcomes by their paths.

    ``unconditional`` has (keys, baseline), the indicator's mean over all paths whatever their
    outcome; recovered tells whether the conditional means, weighed by their paths, give it
    back, which they do not if an outcome's paths are missing or counted twice.
    """
    known = means.join(unconditional.select(*keys, "baseline"), list(keys))
    square = F.col("n") * (F.col("conditional") - F.col("baseline")) * (F.col("conditional") - F.col("baseline"))
    sums = known.groupBy(*keys).agg(
        F.first("baseline").alias("baseline"),
        F.sqrt(F.sum(square) / F.sum("n")).alias("rms"),
        (F.max("conditional") - F.min("conditional")).alias("swing"),
        (F.sum(F.col("n") * F.col("conditional")) / F.sum("n")).alias("back"),
    )
    return sums.select(*keys, "baseline", "rms", "swing", (F.abs(F.col("back") - F.col("baseline")) < 1e-9).alias("recovered"))


def prefix_totals(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, team, played, points, gd) after each of a team's matches, by date and then id."""
    rows = sides(matches, [*keys, "match_date"])
    order = Window.partitionBy(*keys, "team").orderBy("match_date", "match_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "team", F.row_number().over(order).alias("played"), F.sum(_points()).over(upto).alias("points"), F.sum(F.col("gf") - F.col("ga")).over(upto).cast("long").alias("gd"))


def derived_adjustments(standings: DataFrame, matches: DataFrame, keys: Sequence[str], reviewed: DataFrame | None = None, zone: str = "Europe/London") -> DataFrame:
    """(keys, team, played, state, adjustment, known_on) of every row of a standings table.

    A table says nothing of a team (state ``unknown``) unless its goal difference is that of
    the team's first ``played`` matches; then a gap in points is an adjustment
    (``adjusted``), known from the day on which the table was retrieved, and no gap is
    ``agrees``. ``reviewed`` (keys, team, adjustment, known_on) goes first (``reviewed``),
    from its own days on; if a usable table has another gap the state is ``contradicted``.

    standings: keys, team, played, points, goal_difference, retrieved_at.
    """
    own = [*keys, "team"]
    prefix = prefix_totals(matches, keys).select(*own, "played", F.col("points").alias("_points"), F.col("gd").alias("_gd"))
    rows = standings.join(prefix, [*own, "played"], "left")
    none = F.col("played") == 0
    points, gd = F.coalesce("_points", F.when(none, 0)), F.coalesce("_gd", F.when(none, 0))
    usable = F.coalesce(gd == F.col("goal_difference"), F.lit(False))
    gap = F.when(usable, F.col("points") - points)
    seen = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("retrieved_at").cast("timestamp_ntz")))
    rows = rows.select(*own, "played", gap.cast("long").alias("gap"), seen.alias("seen"))
    state = F.when(F.col("gap").isNull(), "unknown").when(F.col("gap") != 0, "adjusted").otherwise("agrees")
    if reviewed is None:
        return rows.select(*own, "played", state.alias("state"), F.when(F.col("gap") != 0, F.col("gap")).alias("adjustment"), F.when(F.col("gap") != 0, F.col("seen")).alias("known_on"))
    known = reviewed.groupBy(*own).agg(F.sum("adjustment").cast("long").alias("_reviewed"), F.max("known_on").alias("_on"))
    rows = rows.join(known, own, "left")
    own_state = F.when(F.col("gap").isNotNull() & (F.col("gap") != F.col("_reviewed")), "contradicted").otherwise("reviewed")
    there = F.col("_reviewed").isNotNull()
    return rows.select(
        *own,
        "played",
        F.when(there, own_state).otherwise(state).alias("state"),
        F.when(there, F.col("_reviewed")).when(F.col("gap") != 0, F.col("gap")).alias("adjustment"),
        F.when(there, F.col("_on")).when(F.col("gap") != 0, F.col("seen")).alias("known_on"),
    )


def complete_tables(found: DataFrame, keys: Sequence[str], teams: int, matches: int) -> DataFrame:
    """(keys, complete): whether a table names the whole field, once each, at the season's end, and is usable throughout."""
    return found.groupBy(*keys).agg(
        ((F.count("*") == teams) & (F.countDistinct("team") == teams) & (F.min("played") == matches) & (F.max("played") == matches) & ~F.bool_or(F.col("state") == "unknown")).alias("complete")
    )


def distribution_summary(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """Mean, deviation, median and central intervals of counted values."""
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("cdf", F.sum(n).over(running) / F.sum(n).over(Window.partitionBy(*keys)))
    at = lambda t: F.min(F.when(F.col("cdf") >= t, F.col(value)))
    mean = F.sum(F.col(n) * F.col(value)) / F.sum(n)
    second = F.sum(F.col(n) * F.col(value) * F.col(value)) / F.sum(n)
    return rows.groupBy(*keys).agg(F.round(mean, 8).alias("mean"), F.round(F.sqrt(second - mean * mean), 7).alias("sd"), at(0.5).alias("median"), at(0.25).alias("low50"), at(0.75).alias("high50"), at(0.1).alias("low80"), at(0.9).alias("high80"))


def ties_that_decide_europe(table: DataFrame, keys: Sequence[str], champions: int) -> DataFrame:
    """(keys, start) of the ties for which it matters to Europe who of them is placed higher.

    ``table`` has keys, team, position, cup, league_cup, and start and end, the range of
    positions of each team's tie. Every two teams of a tie change places in turn; the tie
    decides if that changes anybody's competition.
    """
    spots = table.filter("end > start").select(*keys, "start", "position")
    pairs = spots.withColumnRenamed("position", "low").join(spots.withColumnRenamed("position", "high"), [*keys, "start"]).filter("low < high")
    # A tie has no more teams than a league: its pairs are few.
    moved = F.when(F.col("position") == F.col("low"), F.col("high")).when(F.col("position") == F.col("high"), F.col("low")).otherwise(F.col("position"))
    trials = table.drop("start", "end").join(pairs, list(keys)).withColumn("position", moved)
    after = european_places(trials, [*keys, "start", "low", "high"], champions, "cup", "league_cup")
    before = european_places(table.drop("start", "end"), list(keys), champions, "cup", "league_cup").select(*keys, "team", F.col("europe").alias("now"))
    changed = after.join(before, [*keys, "team"]).filter(~F.col("europe").eqNullSafe(F.col("now")))
    return changed.select(*keys, "start").distinct()


def ranked_table(matches: DataFrame, ranking: str, keys: Sequence[str] = (), relegated: int = 3, boundaries: Sequence[int] = (), sanctions: DataFrame | None = None, europe: tuple[int, DataFrame] | None = None) -> DataFrame:
    """(keys, team, played, points, gd, gf, position_from, position_to) after tie-breaks.

    All rankings go by points, difference and goals. Teams that tie then compare, under
    ``efl``, points, difference and goals among themselves, then wins and away goals of the
    season; under ``head_to_head``, points and away goals among themselves, but only if the
    tie decides the title, relegation, a place in ``boundaries`` or, with ``europe``, a European
    place; under ``shared`` nothing. What still ties shares its range of positions. ``matches``
    carries the keys. ``europe`` is the number of places in the first competition and a table
    (keys, cup, league_cup) of the cup winners.
    """
    table = league_table(matches, sanctions, keys)
    base = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"))
    tied = Window.partitionBy(*keys, "points", "gd", "gf")
    placed = table.withColumn("_start", F.rank().over(base)).withColumn("_n", F.count("*").over(tied)).withColumn("_teams", F.count("*").over(Window.partitionBy(*keys)))
    start, end = F.col("_start"), F.col("_start") + F.col("_n") - 1
    decisive = start == 1
    for place in [F.col("_teams") - relegated, *[F.lit(b) for b in boundaries]]:
        decisive = decisive | ((start <= place) & (place < end))
    if europe is not None:
        if not keys:
            raise ValueError("European places need the keys of the season")
        row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team"))
        ordered = placed.select(*keys, "team", row.alias("position"), start.alias("start"), end.alias("end")).join(europe[1], list(keys))
        deciding = ties_that_decide_europe(ordered, keys, europe[0]).select(*keys, F.col("start").alias("_start"), F.lit(True).alias("_europe"))
        placed = placed.join(deciding, [*keys, "_start"], "left")
        decisive = decisive | F.coalesce("_europe", F.lit(False))
    compare = (F.col("_n") > 1) & (F.lit(ranking == "efl") | (F.lit(ranking == "head_to_head") & decisive))
    placed = placed.withColumn("_compare", compare)
    whole = sides(matches, keys)
    season = whole.groupBy(*keys, "team").agg(F.count_if(F.col("gf") > F.col("ga")).alias("_wins"), F.sum(F.when(F.col("venue") == "away", F.col("gf")).otherwise(0)).alias("_away"))
    own = placed.filter("_compare").select(*keys, "team", F.col("_start").alias("_tie"))
    other = own.select(*keys, F.col("team").alias("opponent"), F.col("_tie").alias("_other"))
    # Only matches between teams of one tie group meet.
    inside = whole.join(own, [*keys, "team"]).join(other, [*keys, "opponent"]).filter("_tie = _other")
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    mini = inside.groupBy(*keys, "team").agg(F.sum(points).alias("_hp"), F.sum(F.col("gf") - F.col("ga")).alias("_hd"), F.sum("gf").alias("_hg"), F.sum(F.when(F.col("venue") == "away", F.col("gf")).otherwise(0)).alias("_ha"))
    rows = placed.join(season, [*keys, "team"]).join(mini, [*keys, "team"], "left")
    used = ["_hp", "_hd", "_hg", "_wins", "_away"] if ranking == "efl" else ["_hp", "_ha"]
    rows = rows.withColumns({c: F.when(F.col("_compare"), F.coalesce(c, F.lit(0))).otherwise(0) for c in used})
    order = Window.partitionBy(*keys).orderBy("_start", *[F.desc(c) for c in used])
    last = Window.partitionBy(*keys, "_start", *used)
    ranked = rows.withColumn("position_from", F.rank().over(order)).withColumn("position_to", (F.col("position_from") + F.count("*").over(last) - 1).cast("int"))
    return ranked.select(*keys, "team", "played", "points", "gd", "gf", "position_from", "position_to")
