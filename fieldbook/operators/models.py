"""Model fitting in Python workers: one task per competition and cutoff.

A group is one competition's training window, which is bounded by its calendar. Nothing
here needs SciPy: the benchmark is convex and is fitted by Newton steps, the daily filter
updates a Gaussian state by the mode and curvature of each day's likelihood.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATINGS = "team string, attack double, defense double, intercept double, home_advantage double, matches long"


def fit_attack_defense(home: np.ndarray, away: np.ndarray, home_goals: np.ndarray, away_goals: np.ndarray, weights: np.ndarray, teams: int, ridge: float = 5.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(attack, defence, intercept, home advantage): penalised weighted Poisson likelihood.

    The effects enter centred; one 1-1 match of average teams keeps the rates finite. The
    design has a row per team and match, so each Newton step is one weighted least squares.
    """
    n, size = len(home), 2 + 2 * teams
    design = np.zeros((2 * n + 2, size))
    design[:, 0] = 1
    design[:n, 1] = 1
    rows = np.arange(n)
    design[rows, 2 + home] += 1
    design[rows, 2 + teams + away] -= 1
    design[n + rows, 2 + away] += 1
    design[n + rows, 2 + teams + home] -= 1
    design[2 * n, 1] = 1
    for part in (slice(2, 2 + teams), slice(2 + teams, size)):
        design[: 2 * n, part] -= design[: 2 * n, part].sum(1, keepdims=True) / teams
    goals = np.concatenate([home_goals, away_goals, [1, 1]]).astype(float)
    w = np.concatenate([weights, weights, [1, 1]])
    penalty = np.full(size, ridge)
    penalty[:2] = 0
    x = np.zeros(size)
    x[0] = math.log((w @ goals) / w.sum())

    def objective(x):
        eta = design @ x
        return w @ (np.exp(eta) - goals * eta) + 0.5 * penalty @ (x * x)

    now = objective(x)
    for _ in range(100):
        mean = np.exp(design @ x)
        gradient = design.T @ (w * (mean - goals)) + penalty * x
        if np.abs(gradient).max() < 1e-9 * max(1, w.sum()):
            break
        step = np.linalg.solve(design.T @ (design * (w * mean)[:, None]) + np.diag(penalty + 1e-10), gradient)
        scale = 1.0
        while (new := objective(x - scale * step)) > now and scale > 1e-8:
            scale /= 2
        x, now = x - scale * step, new
    attack, defense = x[2 : 2 + teams], x[2 + teams :]
    return attack - attack.mean(), defense - defense.mean(), float(x[0]), float(x[1])


def half_life_weights(ages: np.ndarray, half_life: float | None) -> np.ndarray:
    return np.ones(len(ages)) if half_life is None else np.exp2(-ages / half_life)


def _fit_group(half_life: float | None, ridge: float, keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["match_date", "match_id"])
        teams = sorted({*rows.home, *rows.away})
        number = {t: k for k, t in enumerate(teams)}
        ages = (pd.to_datetime(rows.as_of) - pd.to_datetime(rows.match_date)).dt.days.to_numpy()
        home, away = rows.home.map(number).to_numpy(), rows.away.map(number).to_numpy()
        attack, defense, base, edge = fit_attack_defense(home, away, rows.home_goals.to_numpy(), rows.away_goals.to_numpy(), half_life_weights(ages, half_life), len(teams), ridge)
        counts = pd.concat([rows.home, rows.away]).value_counts()
        out = pd.DataFrame({"team": teams, "attack": attack, "defense": defense, "intercept": base, "home_advantage": edge, "matches": [int(counts[t]) for t in teams]})
        for key in reversed(keys):
            out.insert(0, key, rows[key].iloc[0])
        return out

    return run


def training_rows(matches: DataFrame, origins: DataFrame, window_days: int) -> DataFrame:
    """Every origin's matches: finished at least a day before it, within the window (0: all).

    A match is known from the day after it on, so none of the origin's own day is seen.
    """
    known = F.date_add(F.col("match_date"), 1) <= F.col("as_of")
    recent = F.lit(True) if not window_days else F.col("match_date") >= F.date_sub(F.col("as_of"), window_days)
    return matches.join(origins, "competition").filter(known & recent)


def fit_ratings(matches: DataFrame, origins: DataFrame, window_days: int = 0, half_life: float | None = 365.0, ridge: float = 5.0) -> DataFrame:
    """(competition, as_of, team, attack, defense, intercept, home_advantage, matches).

    matches: match_id, competition, match_date, home, away, home_goals, away_goals; origins:
    competition, as_of. Fits run side by side, one task per competition and origin.
    """
    rows = training_rows(matches, origins, window_days)
    return rows.groupBy("competition", "as_of").applyInPandas(_fit_group(half_life, ridge, ["competition", "as_of"]), f"competition string, as_of date, {RATINGS}")


def predict(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """Fixtures (match_id, competition, as_of, home, away) with their rates; unknown teams are average."""
    side = lambda name: ratings.select("competition", "as_of", F.col("team").alias(name), F.col("attack").alias(f"{name}_attack"), F.col("defense").alias(f"{name}_defense"))
    base = ratings.groupBy("competition", "as_of").agg(F.first("intercept").alias("intercept"), F.first("home_advantage").alias("edge"))
    keys = ["competition", "as_of"]
    rows = fixtures.join(base, keys).join(side("home"), [*keys, "home"], "left").join(side("away"), [*keys, "away"], "left").fillna(0.0, ["home_attack", "home_defense", "away_attack", "away_defense"])
    home = F.exp(F.col("intercept") + F.col("edge") + F.col("home_attack") - F.col("away_defense"))
    away = F.exp(F.col("intercept") + F.col("away_attack") - F.col("home_defense"))
    return rows.select("match_id", *keys, "home", "away", home.alias("home_rate"), away.alias("away_rate"))


#: Models by kind: (matches, origins, fixtures, options) -> rates of the fixtures.
MODELS: dict[str, Callable[..., DataFrame]] = {}


def model(kind: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a model. It sees only what ``training_rows`` gives it of each origin, and gives
    (match_id, competition, as_of, home, away, home_rate, away_rate) for every fixture."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if kind in MODELS:
            raise ValueError(f"model {kind} is registered twice")
        MODELS[kind] = function
        return function

    return register


def rates_of(kind: str, matches: DataFrame, origins: DataFrame, fixtures: DataFrame, **options) -> DataFrame:
    """The rates that a kind of model gives to fixtures (match_id, competition, as_of, home, away)."""
    if kind not in MODELS:
        raise ValueError(f"no model of kind {kind!r}: {', '.join(sorted(MODELS))}")
    return MODELS[kind](matches, origins, fixtures, **options)


@model("attack_defence")
def _attack_defence(matches: DataFrame, origins: DataFrame, fixtures: DataFrame, **options) -> DataFrame:
    return predict(fixtures, fit_ratings(matches, origins, **options))


@model("average")
def _average(matches: DataFrame, origins: DataFrame, fixtures: DataFrame, window_days: int = 0) -> DataFrame:
    """All teams alike: the competition's mean goals at home and away."""
    means = training_rows(matches, origins, window_days).groupBy("competition", "as_of").agg(F.avg("home_goals").alias("home_rate"), F.avg("away_goals").alias("away_rate"))
    return fixtures.join(means, ["competition", "as_of"]).select("match_id", "competition", "as_of", "home", "away", "home_rate", "away_rate")


def backtest(matches: DataFrame, origins: DataFrame, window_days: int = 0, horizon_days: int = 28, **options) -> DataFrame:
    """Rolling origins: each origin's fixtures, predicted from what was known at it."""
    ahead = matches.join(origins, "competition").filter((F.col("match_date") >= F.col("as_of")) & (F.col("match_date") < F.date_add(F.col("as_of"), horizon_days)))
    found = predict(ahead.select("match_id", "competition", "as_of", "home", "away"), fit_ratings(matches, origins, window_days, **options))
    return found.join(ahead.select("match_id", "competition", "as_of", "home_goals", "away_goals"), ["match_id", "competition", "as_of"])


# --- the daily state filter


class DailyFilter:
    """A Gaussian state of log scoring rate, home edge, and each team's quality and tilt.

    Day by day: deviations decay to zero and gain variance (an Ornstein-Uhlenbeck step), new
    teams enter with their prior, and all matches of the day update the state at once by
    Laplace's method. ``evidence`` adds up the days' log marginal likelihoods.
    """

    def __init__(self, decay_days: float = 700.0, team_sd: float = 0.35, base_sd: float = 0.3):
        self.decay_days, self.team_sd = decay_days, team_sd
        self.teams: list[str] = []
        self.mean = np.array([math.log(1.3), 0.2])
        self.cov = np.diag([base_sd**2, 0.15**2])
        self.day: int | None = None
        self.evidence = 0.0

    def advance(self, day: int) -> None:
        if self.day is not None and day < self.day:
            raise ValueError("days must not go back")
        if self.day is not None and len(self.teams):
            keep = math.exp(-(day - self.day) / self.decay_days)
            factor = np.ones(len(self.mean))
            factor[2:] = keep
            self.mean = self.mean * factor
            self.cov = self.cov * factor[:, None] * factor[None, :]
            self.cov[np.arange(2, len(self.mean)), np.arange(2, len(self.mean))] += self.team_sd**2 * (1 - keep**2)
        self.day = day

    def enter(self, team: str, quality: float = 0.0) -> None:
        n = len(self.mean)
        self.teams.append(team)
        self.mean = np.concatenate([self.mean, [quality, 0.0]])
        cov = np.zeros((n + 2, n + 2))
        cov[:n, :n] = self.cov
        cov[n, n], cov[n + 1, n + 1] = self.team_sd**2, (self.team_sd / 2) ** 2
        self.cov = cov

    def design(self, home: str, away: str) -> np.ndarray:
        """Rows of the two log rates: quality moves the teams apart, tilt moves both rates."""
        rows = np.zeros((2, len(self.mean)))
        h, a = (2 + 2 * self.teams.index(t) for t in (home, away))
        rows[:, 0] = 1
        rows[0, 1] = 1
        rows[0, [h, a]] = 0.5, -0.5
        rows[1, [h, a]] = -0.5, 0.5
        rows[:, [h + 1, a + 1]] = 0.5
        return rows

    def update(self, matches: list[tuple[str, str, int, int]]) -> None:
        for home, away, *_ in matches:
            for team in (home, away):
                if team not in self.teams:
                    self.enter(team)
        rows = np.concatenate([self.design(h, a) for h, a, *_ in matches])
        goals = np.array([g for *_, x, y in matches for g in (x, y)], float)
        # In the space of the observed rates: the state only moves along cov @ rows.
        spread = rows @ self.cov @ rows.T
        prior, u = rows @ self.mean, np.zeros(len(goals))
        for _ in range(50):
            eta = prior + spread @ u
            rate = np.exp(np.clip(eta, -20, 5))
            step = np.linalg.solve(np.eye(len(goals)) + rate[:, None] * spread, u - (goals - rate))
            u = u - step
            if np.abs(step).max() < 1e-10:
                break
        eta = prior + spread @ u
        rate = np.exp(eta)
        gain = self.cov @ rows.T
        inner = np.eye(len(goals)) + rate[:, None] * spread
        self.evidence += float((goals * eta - rate).sum() - sum(map(math.lgamma, goals + 1)) - 0.5 * u @ spread @ u - 0.5 * np.linalg.slogdet(inner)[1])
        self.mean = self.mean + gain @ u
        self.cov = self.cov - gain @ np.linalg.solve(inner, rate[:, None] * gain.T)
        self.cov = (self.cov + self.cov.T) / 2

    def fit(self, matches: list[tuple[int, str, str, int, int]]) -> "DailyFilter":
        """Matches (day, home, away, goals, goals) in order of days; may be called again with later days."""
        days: dict[int, list] = {}
        for day, *match in sorted(matches):
            days.setdefault(day, []).append(tuple(match))
        for day, some in days.items():
            self.advance(day)
            self.update(some)
        return self

    def rates(self, home: str, away: str) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the two log rates of a match."""
        for team in (home, away):
            if team not in self.teams:
                self.enter(team)
        rows = self.design(home, away)
        return rows @ self.mean, rows @ self.cov @ rows.T


    def dump(self) -> str:
        """The whole state as text; ``load`` goes on from it as if it had never stopped."""
        parts = {"decay_days": self.decay_days, "team_sd": self.team_sd, "teams": self.teams, "mean": self.mean.tolist(), "cov": self.cov.tolist(), "day": self.day, "evidence": self.evidence}
        return json.dumps(parts)

    @classmethod
    def load(cls, text: str) -> "DailyFilter":
        parts = json.loads(text)
        model = cls(parts["decay_days"], parts["team_sd"])
        model.teams, model.day, model.evidence = parts["teams"], parts["day"], parts["evidence"]
        model.mean, model.cov = np.array(parts["mean"]), np.array(parts["cov"])
        return model


STORED = "competition string, state string"


def continue_filters(matches: DataFrame, stored: DataFrame | None = None, **options) -> DataFrame:
    """(competition, state): the stored filters, or new ones, after these matches.

    Matches must be later than what a state has seen; an earlier day raises. Competitions
    without new matches keep their state.
    """
    rows = matches.withColumn("day", F.datediff("match_date", F.lit("1970-01-01").cast("date"))).select("competition", "match_id", "day", "home", "away", "home_goals", "away_goals")
    known = stored if stored is not None else matches.sparkSession.createDataFrame([], STORED)

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        competition = (new if len(new) else old).competition.iloc[0]
        model = DailyFilter.load(old.state.iloc[0]) if len(old) else DailyFilter(**options)
        order = new.sort_values(["day", "match_id"])
        model.fit(list(order[["day", "home", "away", "home_goals", "away_goals"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"competition": [competition], "state": [model.dump()]})

    return rows.groupBy("competition").cogroup(known.groupBy("competition")).applyInPandas(run, STORED)


STATE = "competition string, member string, team string, quality double, tilt double, quality_sd double, evidence double, as_of_day long"


def filter_states(matches: DataFrame, members: dict[str, dict]) -> DataFrame:
    """The fitted state of every competition under every member of a mixture, side by side."""
    names = F.explode(F.array(*[F.lit(m) for m in sorted(members)]))
    rows = matches.withColumn("member", names).withColumn("day", F.datediff("match_date", F.lit("1970-01-01").cast("date")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        competition, member = group.competition.iloc[0], group.member.iloc[0]
        order = group.sort_values(["day", "match_id"])
        model = DailyFilter(**members[member]).fit(list(order[["day", "home", "away", "home_goals", "away_goals"]].itertuples(index=False, name=None)))
        n = len(model.teams)
        at = 2 + 2 * np.arange(n)
        return pd.DataFrame({"competition": competition, "member": member, "team": model.teams, "quality": model.mean[at], "tilt": model.mean[at + 1], "quality_sd": np.sqrt(model.cov[at, at]), "evidence": model.evidence, "as_of_day": int(model.day)})

    return rows.groupBy("competition", "member").applyInPandas(run, STATE)


# --- chances behind goals and expected goals


def chance_likelihood(goals: int, xg: float, log_rate: float, p: float) -> tuple[float, float, float]:
    """(log likelihood, its slope, minus its second derivative) in the log scoring rate.

    N chances are Poisson with mean rate/p, each a goal with probability p, and their quality
    adds up to xg, gamma with shape N and scale p. N is summed out until the terms vanish.
    A missing xg leaves the Poisson count of goals; xg 0 means no chance at all.
    """
    rate = math.exp(log_rate)
    if math.isnan(xg):
        return goals * log_rate - rate - math.lgamma(goals + 1), goals - rate, rate
    if xg == 0:
        if goals:
            raise ValueError("goals without any chance")
        return -rate / p, -rate / p, rate / p
    low = max(goals, 1)
    width = 64
    while True:
        n = np.arange(low, low + width, dtype=float)
        log_gamma = np.array([math.lgamma(x) for x in n])
        log_missed = np.array([math.lgamma(x - goals + 1) for x in n])
        terms = n * (log_rate - math.log(p)) - math.lgamma(goals + 1) - log_missed + goals * math.log(p) + (n - goals) * math.log1p(-p) + (n - 1) * math.log(xg) - xg / p - n * math.log(p) - log_gamma
        top = terms.max()
        weights = np.exp(terms - top)
        if weights[-1] < 1e-16 * weights.sum():
            break
        width *= 2
        if width > 1 << 16:
            raise ValueError("the sum over chances does not converge")
    total = weights.sum()
    mean = float(weights @ n / total)
    spread = float(weights @ (n - mean) ** 2 / total)
    return float(top + math.log(total) - rate / p), mean - rate / p, rate / p - spread


def entry_priors(entrants: DataFrame, cohort: str, value: str, error: str, least: int = 6) -> DataFrame:
    """(cohort, n, prior_mean, prior_variance) of newcomers' strength, by empirical Bayes.

    The spread of a cohort's estimates less their mean error variance is its own variance;
    a cohort of fewer than ``least`` entrants takes the whole population's.
    """
    square = F.col(error) * F.col(error)
    stats = [F.count("*").alias("n"), F.avg(value).alias("m"), F.greatest(F.var_pop(value) - F.avg(square), F.lit(0.0)).alias("v")]
    whole = entrants.agg(F.avg(value).alias("all_m"), F.greatest(F.var_pop(value) - F.avg(square), F.lit(0.0)).alias("all_v"))
    own = F.col("n") >= least
    rows = entrants.groupBy(cohort).agg(*stats).join(F.broadcast(whole))  # one row
    return rows.select(cohort, "n", F.when(own, F.col("m")).otherwise(F.col("all_m")).alias("prior_mean"), F.when(own, F.col("v")).otherwise(F.col("all_v")).alias("prior_variance"))
