"""Fits, the daily filter, and season paths: optimality, chronology, conservation."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import models, simulate, tables


def matches(spark, n=240, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        h, a = draw.choice(8, 2, replace=False)
        day = datetime.date(2021, 1, 1) + datetime.timedelta(days=k // 3)
        rows.append((f"m{k:04d}", "north", day, f"t{h}", f"t{a}", int(draw.poisson(1.4 * 1.15 ** (h - a))), int(draw.poisson(1.1 * 1.15 ** (a - h)))))
    return spark.createDataFrame(rows, "match_id string, competition string, match_date date, home string, away string, home_goals int, away_goals int")


def test_fit_is_a_minimum():
    draw = np.random.default_rng(1)
    home, away = draw.integers(0, 5, 80), draw.integers(0, 5, 80)
    x, y = draw.poisson(1.5, 80), draw.poisson(1.1, 80)
    w = np.exp2(-draw.random(80))
    attack, defense, base, edge = models.fit_attack_defense(home, away, x, y, w, 5)

    def objective(attack, defense, base, edge):
        a, d = attack - attack.mean(), defense - defense.mean()
        eh, ea = base + edge + a[home] - d[away], base + a[away] - d[home]
        return (w * (np.exp(eh) - x * eh + np.exp(ea) - y * ea)).sum() + 2.5 * ((attack**2).sum() + (defense**2).sum()) + np.exp(base + edge) + np.exp(base) - 2 * base - edge

    best = objective(attack, defense, base, edge)
    for _ in range(200):
        step = draw.normal(size=12) * 1e-3
        assert objective(attack + step[:5], defense + step[5:10], base + step[10], edge + step[11]) >= best - 1e-9
    assert attack.sum() == pytest.approx(0) and defense.sum() == pytest.approx(0)


def test_no_goals_at_all_stays_finite():
    z = np.zeros(6, int)
    out = models.fit_attack_defense(np.array([0, 1, 0, 1, 0, 1]), np.array([1, 0, 1, 0, 1, 0]), z, z, np.ones(6), 2)
    assert np.isfinite(out[2]) and np.isfinite(out[0]).all()


def test_the_future_changes_nothing(spark):
    rows = matches(spark)
    origins = spark.createDataFrame([("north", datetime.date(2021, 2, 15))], "competition string, as_of date")
    later = F.col("match_date") >= F.lit("2021-02-15").cast("date")
    changed = rows.withColumn("home_goals", F.when(later, 9).otherwise(F.col("home_goals")))
    a, b = (models.fit_ratings(r, origins).orderBy("team").toPandas() for r in (rows, changed))
    pd.testing.assert_frame_equal(a, b)


def test_backtest_rows(spark):
    origins = spark.createDataFrame([("north", datetime.date(2021, 2, d)) for d in (1, 20)], "competition string, as_of date")
    found = models.backtest(matches(spark), origins, horizon_days=7)
    assert found.count() == 42 and found.filter("home_rate <= 0 or away_rate <= 0").isEmpty()


def test_filter_prefix_then_rest_equals_all(spark):
    rows = [(r.match_date.toordinal(), r.home, r.away, r.home_goals, r.away_goals) for r in matches(spark).collect()]
    rows.sort()
    middle = next(k for k in range(100, len(rows)) if rows[k][0] != rows[k - 1][0])
    whole, parts = models.DailyFilter().fit(rows), models.DailyFilter().fit(rows[:middle]).fit(rows[middle:])
    assert np.allclose(whole.mean, parts.mean) and np.allclose(whole.cov, parts.cov) and whole.evidence == pytest.approx(parts.evidence)
    with pytest.raises(ValueError):
        whole.advance(rows[0][0])


def test_update_is_the_mode():
    model = models.DailyFilter()
    for t in "abcd":
        model.enter(t)
    prior_mean, prior_cov = model.mean.copy(), model.cov.copy()
    day = [("a", "b", 3, 0), ("c", "d", 1, 1)]
    rows = np.concatenate([model.design(h, a) for h, a, *_ in day])
    model.update(day)
    gradient = rows.T @ (np.array([3, 0, 1, 1]) - np.exp(rows @ model.mean)) - np.linalg.solve(prior_cov, model.mean - prior_mean)
    assert np.abs(gradient).max() < 1e-8
    precision = np.linalg.inv(prior_cov) + rows.T @ (np.exp(rows @ model.mean)[:, None] * rows)
    assert np.allclose(np.linalg.inv(precision), model.cov, atol=1e-10)


def season(spark):
    teams = [f"t{k}" for k in range(6)]
    fixtures = [(f"{h}-{a}", h, a, 1.4, 1.1) for h in teams for a in teams if h < a]
    played = [(f"{h}-{a}", h, a, 1, 0) for h in teams for a in teams if h > a]
    return spark.createDataFrame(fixtures, "match_id string, home string, away string, home_rate double, away_rate double"), spark.createDataFrame(played, "match_id string, home string, away string, home_goals int, away_goals int")


def test_paths_conserve(spark):
    fixtures, played = season(spark)
    paths = simulate.simulate(spark, fixtures, played, 1200, seed=3)
    whole = paths.groupBy("path").agg(F.sum("points").alias("p"), F.sum("gd").alias("gd"), F.sum("champion").alias("c"), F.sum("promoted").alias("u"), F.sum("position").alias("s"), F.count("*").alias("n"))
    assert whole.filter("gd <> 0 or c <> 1 or u <> 3 or s <> 21 or n <> 6 or p not between 75 and 90").isEmpty() and whole.count() == 1200
    again = simulate.simulate(spark, fixtures, played, 1200, seed=3)
    assert paths.exceptAll(again.repartition(3)).isEmpty()
    summary = simulate.season_summary(paths).collect()
    assert sum(r.champion for r in summary) == pytest.approx(1) and sum(r.promoted for r in summary) == pytest.approx(3)


def test_conditional_means_recover_the_baseline(spark):
    rows = spark.range(3000).select((F.col("id") % 4).alias("team"), (F.col("id") * 7 % 5 % 3).alias("outcome"), ((F.col("id") * 13) % 11 > 4).cast("double").alias("x"))
    whole = rows.groupBy("team").agg(F.avg("x").alias("baseline"))
    summary = tables.impact_summary(tables.conditional_means(rows, ["team"], "outcome", "x"), ["team"], whole)
    assert summary.filter("not recovered or rms < 0 or swing < 0").isEmpty()


def test_tied_teams_share_positions(spark):
    table = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 7), ("e", 1)], "team string, points int")
    mass = tables.position_mass(table, [], ["points"])
    assert mass.groupBy("position").agg(F.round(F.sum("mass"), 9).alias("m")).filter("m <> 1").isEmpty()
    assert {(r.team, r.position, round(r.mass, 6)) for r in mass.collect() if r.team == "c"} == {("c", k, 0.333333) for k in (2, 3, 4)}


def test_head_to_head(spark):
    rows = spark.createDataFrame([("1", "a", "b", 2, 0), ("2", "b", "a", 1, 1), ("3", "a", "c", 0, 5)], "match_id string, home string, away string, home_goals int, away_goals int")
    ties = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "team string, tie int")
    assert sorted(tuple(r) for r in tables.head_to_head(rows, ties).collect()) == [("a", 4, 2, 3, 1), ("b", 1, -2, 1, 0)]


def test_chance_likelihood_adds_up_and_has_its_slope():
    draw = np.random.default_rng(3)
    for goals, xg in ((0, 0.3), (2, 1.7), (1, 0.05), (3, float("nan")), (0, 0.0)):
        at = lambda eta: models.chance_likelihood(goals, xg, eta, 0.15)[0]  # noqa: E731, B023
        eta = draw.normal() / 3
        _, slope, curve = models.chance_likelihood(goals, xg, eta, 0.15)
        assert slope == pytest.approx((at(eta + 1e-5) - at(eta - 1e-5)) / 2e-5, abs=1e-4)
        assert curve == pytest.approx(-(at(eta + 1e-3) - 2 * at(eta) + at(eta - 1e-3)) / 1e-6, abs=1e-3)
    grid = np.arange(0.0005, 12, 0.001)
    some = sum(np.exp([models.chance_likelihood(g, x, 0.1, 0.15)[0] for x in grid]).sum() * 0.001 for g in range(7))
    none = np.exp(models.chance_likelihood(0, 0.0, 0.1, 0.15)[0])
    assert some + none == pytest.approx(1, abs=2e-3)
    with pytest.raises(ValueError):
        models.chance_likelihood(1, 0.0, 0.0, 0.15)


def test_european_places(spark):
    rows = lambda cup, league_cup: [(f"t{k}", k, cup, league_cup) for k in range(1, 11)]
    for cup, league_cup, europa, conference in (("t9", "t10", {"t5", "t9"}, "t10"), ("t1", "t2", {"t5", "t6"}, "t7"), ("t9", "t5", {"t5", "t9"}, "t6"), ("t9", "t9", {"t5", "t9"}, "t6")):
        table = spark.createDataFrame(rows(cup, league_cup), "team string, position int, cup string, league_cup string")
        found = simulate.european_places(table, [], 4, "cup", "league_cup").collect()
        assert {r.team for r in found if r.europe == "europa_league"} == europa
        assert [r.team for r in found if r.europe == "conference_league"] == [conference]
        assert sum(r.europe == "champions_league" for r in found) == 4


def test_sampled_states(spark):
    states = spark.createDataFrame([("a", 0.5, 0.1), ("b", -0.5, 0.2)], "team string, quality double, quality_sd double")
    paths = simulate.sample_states(spark, states, 4000, 0, seed=4)
    got = {r.team: (r.m, r.s) for r in paths.groupBy("team").agg(F.avg("quality").alias("m"), F.stddev("quality").alias("s")).collect()}
    assert got["a"] == pytest.approx((0.5, 0.1), abs=0.01) and got["b"] == pytest.approx((-0.5, 0.2), abs=0.02)


def test_brackets():
    draw = np.random.default_rng(0)
    for places in (4, 6):
        position = np.array([draw.permutation(10) + 1 for _ in range(3000)])
        strength = np.zeros(10)
        won = simulate.bracket(position, strength, 3, draw, places)
        place = position[np.arange(3000), won]
        assert place.min() == 3 and place.max() == 2 + places
        share = np.bincount(place, minlength=10)[3 : 3 + places] / 3000
        assert share[0] > share[-1] or places == 4 and abs(share - 0.25).max() < 0.04
        strong = simulate.bracket(np.tile(np.arange(1, 11), (400, 1)), np.r_[0.0, 0, 0, 0, 5, 0, 0, 0, 0, 0], 3, draw, places)
        assert (strong == 4).mean() > 0.95
    with pytest.raises(ValueError):
        simulate.bracket(position, strength, 3, draw, 5)


def results(spark, *rows):
    return spark.createDataFrame([(f"m{k}", *r) for k, r in enumerate(rows)], "match_id string, home string, away string, home_goals int, away_goals int")


def places(frame):
    return {r.team: (r.position_from, r.position_to) for r in frame.collect()}


def test_tie_breaks(spark):
    # a and b are level on points, difference and goals; b won at a's ground.
    level = results(spark, ("a", "b", 0, 1), ("b", "a", 0, 0), ("a", "c", 3, 0), ("c", "b", 0, 0), ("a", "d", 1, 0), ("d", "b", 1, 4), ("c", "a", 1, 0), ("b", "c", 0, 3), ("d", "c", 0, 0))
    plain = {r.team: (r.points, r.gd, r.gf) for r in tables.league_table(level).collect()}
    tie = {t for t in plain if list(plain.values()).count(plain[t]) > 1}
    shared = places(tables.ranked_table(level, "shared", relegated=1))
    assert all(shared[t][1] > shared[t][0] for t in tie)
    for ranking in ("efl", "head_to_head"):
        assert len(places(tables.ranked_table(level, ranking, relegated=1))) == 4


def test_a_decisive_tie_goes_to_head_to_head(spark):
    rows = results(spark, ("a", "b", 2, 1), ("b", "c", 1, 0), ("c", "a", 1, 0), ("b", "d", 1, 0), ("a", "d", 1, 1), ("c", "d", 0, 1), ("d", "a", 0, 1))
    plain = {r.team: (r.points, r.gd, r.gf) for r in tables.league_table(rows).collect()}
    assert plain["a"][0] == 7 and plain["b"][0] == 6
    level = results(spark, ("a", "b", 1, 0), ("a", "c", 0, 1), ("b", "c", 1, 0), ("c", "d", 0, 0), ("d", "e", 0, 0))
    points = {r.team: (r.points, r.gd, r.gf) for r in tables.league_table(level).collect()}
    assert points["a"] == points["b"] == (3, 0, 1)
    assert places(tables.ranked_table(level, "shared", relegated=1))["a"] == places(tables.ranked_table(level, "shared", relegated=1))["b"] == (2, 3)
    assert places(tables.ranked_table(level, "head_to_head", relegated=1))["a"] == (2, 3)  # decides nothing
    assert places(tables.ranked_table(level, "head_to_head", relegated=3))["a"] == (2, 2)  # decides relegation
    assert places(tables.ranked_table(level, "head_to_head", relegated=1, boundaries=[2]))["b"] == (3, 3)
    assert places(tables.ranked_table(level, "efl", relegated=1))["a"] == (2, 2)


def test_missing_paths_are_not_recovered(spark):
    rows = spark.createDataFrame([("a", k % 3, float(k % 2)) for k in range(30)] + [("a", 0, 1.0)], "team string, outcome int, x double")
    whole = rows.groupBy("team").agg(F.avg("x").alias("baseline"))
    means = tables.conditional_means(rows, ["team"], "outcome", "x")
    assert tables.impact_summary(means, ["team"], whole).first().recovered
    assert not tables.impact_summary(means.filter("outcome > 0"), ["team"], whole).first().recovered


def test_tables_of_two_seasons(spark):
    rows = [(s, f"{s}{h}{a}", h, a, (h == "a") + (s == 2 and h == "c") * 3, 0) for s in (1, 2) for h in "abc" for a in "abc" if h != a]
    matches = spark.createDataFrame(rows, "season int, match_id string, home string, away string, home_goals int, away_goals int")
    sanctions = spark.createDataFrame([(1, "a", -6), (1, "a", -1), (2, "c", -1)], "season int, team string, adjustment int")
    table = {(r.season, r.team): (r.played, r.points) for r in tables.league_table(matches, sanctions, ["season"]).collect()}
    assert table == {(1, "a"): (4, 8 - 7), (1, "b"): (4, 3), (1, "c"): (4, 3), (2, "a"): (4, 7), (2, "b"): (4, 2), (2, "c"): (4, 7 - 1)}
    places = {(r.season, r.team): r.position_from for r in tables.ranked_table(matches, "efl", ["season"], sanctions=sanctions).collect()}
    assert places[1, "a"] == 3 and places[2, "a"] == 1 and len(places) == 6
    ties = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "b", 1), (2, "c", 1)], "season int, team string, tie int")
    mini = {(r.season, r.team): r.h2h_points for r in tables.head_to_head(matches, ties, ["season"]).collect()}
    assert set(mini) == {(1, "a"), (1, "b"), (2, "b"), (2, "c")} and mini[2, "c"] == 4


def test_more_teams_than_a_season_has(spark, monkeypatch):
    monkeypatch.setattr(simulate, "MOST_TEAMS", 2)
    states = spark.createDataFrame([(t, 0.0, 0.1) for t in "abc"], "team string, quality double, quality_sd double")
    with pytest.raises(ValueError, match="more teams"):
        simulate.sample_states(spark, states, 10, 0)


def plain_europe(order, champions, cup, league_cup):
    """The competitions of teams in their order, one place after another."""
    first = order[:champions]
    second = [cup] if cup not in first else []
    second += [t for t in order if t not in first and t != cup][: 2 - len(second)]
    rest = [t for t in order if t not in first + second]
    third = [league_cup] if league_cup in rest else rest[:1]
    return {t: name for name, some in (("champions_league", first), ("europa_league", second), ("conference_league", third)) for t in some}


def test_ties_that_decide_europe(spark):
    draw = np.random.default_rng(5)
    rows, want = [], set()
    for season in range(40):
        teams, size = [f"t{k}" for k in range(9)], 0
        cup, league_cup = draw.choice(teams, 2)
        base = plain_europe(teams, 3, cup, league_cup)
        while size < 9:
            n = min(int(draw.integers(1, 4)), 9 - size)
            for a in range(size, size + n):
                rows.append((season, teams[a], a + 1, size + 1, size + n, str(cup), str(league_cup)))
                for b in range(a + 1, size + n):
                    other = list(teams)
                    other[a], other[b] = other[b], other[a]
                    if plain_europe(other, 3, cup, league_cup) != base:
                        want.add((season, size + 1))
            size += n
    table = spark.createDataFrame(rows, "season int, team string, position int, start int, end int, cup string, league_cup string")
    got = {tuple(r) for r in tables.ties_that_decide_europe(table, ["season"], 3).collect()}
    assert got == want and 10 < len(want) < len({(r[0], r[3]) for r in rows if r[4] > r[3]})


def test_a_tie_for_europe_is_played_out(spark):
    # b and c tie for the second place, a wins all; c won their matches by away goals.
    games = [("a", "b", 1, 0), ("a", "c", 1, 0), ("b", "a", 0, 1), ("c", "a", 0, 1), ("b", "c", 1, 2), ("c", "b", 0, 1), ("d", "b", 0, 1), ("d", "c", 0, 1), ("a", "d", 1, 0), ("e", "d", 0, 1)]
    matches = spark.createDataFrame([(1, f"{h}{a}", h, a, x, y) for h, a, x, y in games], "season int, match_id string, home string, away string, home_goals int, away_goals int")
    cups = spark.createDataFrame([(1, "a", "a")], "season int, cup string, league_cup string")
    place = lambda **more: {r.team: (r.position_from, r.position_to) for r in tables.ranked_table(matches, "head_to_head", ["season"], relegated=1, **more).collect()}
    assert place()["b"] == place()["c"] == (2, 3)
    assert place(europe=(2, cups))["c"] == (2, 2) and place(europe=(2, cups))["b"] == (3, 3)
    assert place(europe=(1, cups))["b"] == (2, 3)  # both are in the second competition, whoever is first


def test_adjustments_from_a_table(spark):
    games = [("a", "b", 2, 0), ("b", "c", 1, 1), ("c", "a", 0, 1), ("a", "c", 1, 1)]
    matches = spark.createDataFrame([("s", f"m{k}", datetime.date(2024, 1, k + 1), h, a, x, y) for k, (h, a, x, y) in enumerate(games)], "season string, match_id string, match_date date, home string, away string, home_goals int, away_goals int")
    at = datetime.datetime(2024, 6, 1, 23, 30)
    table = spark.createDataFrame([("s", "a", 2, 0, 3, at), ("s", "b", 2, 1, -2, at), ("s", "c", 2, 1, 5, at), ("s", "d", 0, 0, 0, at), ("s", "e", 0, -2, 0, at)], "season string, team string, played int, points int, goal_difference int, retrieved_at timestamp")
    found = {r.team: (r.state, r.adjustment, r.known_on) for r in tables.derived_adjustments(table, matches, ["season"]).collect()}
    day = datetime.date(2024, 6, 2)
    assert found == {"a": ("adjusted", -6, day), "b": ("agrees", None, None), "c": ("unknown", None, None), "d": ("agrees", None, None), "e": ("adjusted", -2, day)}
    own = datetime.date(2024, 3, 1)
    reviewed = spark.createDataFrame([("s", "a", -4, own), ("s", "a", -2, own), ("s", "b", -1, own), ("s", "c", -3, own)], "season string, team string, adjustment int, known_on date")
    rows = tables.derived_adjustments(table, matches, ["season"], reviewed)
    assert {r.team: (r.state, r.adjustment) for r in rows.collect()} == {"a": ("reviewed", -6), "b": ("contradicted", -1), "c": ("reviewed", -3), "d": ("agrees", None), "e": ("adjusted", -2)}
    assert not tables.complete_tables(rows, ["season"], 5, 2).first().complete
    whole = table.filter("team in ('a', 'b')")
    assert tables.complete_tables(tables.derived_adjustments(whole, matches, ["season"]), ["season"], 2, 2).first().complete


def test_models_by_kind(spark):
    with pytest.raises(ValueError, match="no model"):
        models.rates_of("other", None, None, None)
    with pytest.raises(ValueError, match="twice"):
        models.model("average")(lambda *a: None)
    day = datetime.date(2024, 1, 1)
    matches = spark.createDataFrame([("m1", "x", day, "a", "b", 3, 1), ("m2", "x", day, "b", "a", 1, 0), ("m3", "x", datetime.date(2024, 6, 1), "a", "b", 9, 9)], "match_id string, competition string, match_date date, home string, away string, home_goals int, away_goals int")
    origins = spark.createDataFrame([("x", datetime.date(2024, 5, 1))], "competition string, as_of date")
    fixtures = spark.createDataFrame([("f", "x", datetime.date(2024, 5, 1), "a", "new")], "match_id string, competition string, as_of date, home string, away string")
    row = models.rates_of("average", matches, origins, fixtures).first()
    assert (row.home_rate, row.away_rate) == (2.0, 0.5)
