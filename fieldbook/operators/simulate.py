"""Season simulation: paths in chunks of fixed size, each with its own random stream.

A chunk's seed is made of the run's seed and the chunk's number, so results do not depend on
partitions or executors. Rates, fixtures and results are broadcast: a season's are a few
hundred rows, and their number is checked. Paths only leave a task as rows per team.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 500
MOST_FIXTURES = 20_000
MOST_TEAMS = 20_000
PATHS = "path long, team string, points int, gd int, gf int, position int, champion double, promoted double"


def _positions(points: np.ndarray, gd: np.ndarray, gf: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Positions from 1 by points, difference and goals; what still ties is in random order."""
    key = (points.astype(np.int64) * 4001 + gd + 2000) * 4001 + gf
    order = np.lexsort((draw.random(key.shape), -key), axis=1)
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(1, key.shape[1] + 1)[None, :].repeat(len(key), 0), 1)
    return out


def bracket(position: np.ndarray, strength: np.ndarray, first: int, draw: np.random.Generator, places: int = 4, base: float = 1.3, edge: float = 0.2) -> np.ndarray:
    """The winner (column) of a playoff of ``places`` teams from the place ``first`` on.

    Of four, the highest meets the lowest over two legs, the higher at home second, and the
    winners meet on neutral ground. Of six, the third to sixth first play single matches at
    the higher's ground, and the semi-finals are seeded anew. Level ties are even.
    """
    if places not in (4, 6):
        raise ValueError(f"no bracket for {places} places")
    rows = np.arange(len(position))
    seed = [(position == first + k).argmax(1) for k in range(places)]

    def goals(home: np.ndarray, away: np.ndarray, neutral: bool = False) -> tuple[np.ndarray, np.ndarray]:
        gap = (strength[home] - strength[away]) / 2 + (0 if neutral else edge)
        return draw.poisson(base * np.exp(gap)), draw.poisson(base * np.exp(-gap))

    def decided(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where((x > y) | ((x == y) & (draw.random(len(rows)) < 0.5)), a, b)

    def two_legs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        low_home, high_away = goals(low, high)
        high_home, low_away = goals(high, low)
        return decided(high, low, high_home + high_away, low_home + low_away)

    if places == 6:
        left = [decided(seed[a], seed[b], *goals(seed[a], seed[b])) for a, b in ((2, 5), (3, 4))]
        ranks = np.stack([position[rows, t] for t in left], 1)
        swap = ranks[:, 0] > ranks[:, 1]
        seed = seed[:2] + [np.where(swap, left[1], left[0]), np.where(swap, left[0], left[1])]
    finalists = two_legs(seed[0], seed[3]), two_legs(seed[1], seed[2])
    return decided(*finalists, *goals(*finalists, neutral=True))


def _play(ahead: list[tuple], past: list[tuple], paths: int, chunk: int, draw: np.random.Generator, promoted: int, playoff: int) -> pd.DataFrame:
    """One chunk of a season's paths."""
    teams = sorted({t for r in [*ahead, *past] for t in r[1:3]})
    number = {t: k for k, t in enumerate(teams)}
    strength = np.zeros(len(teams))
    for _, h, a, x, y in ahead:
        strength[number[h]] += (x - y) / 10
        strength[number[a]] += (y - x) / 10
    size = min(CHUNK, paths - chunk * CHUNK)
    points, gf, ga = (np.zeros((size, len(teams)), np.int32) for _ in range(3))

    def add(h, a, x, y):
        gf[:, h] += x
        ga[:, h] += y
        gf[:, a] += y
        ga[:, a] += x
        points[:, h] += np.where(x > y, 3, x == y).astype(np.int32)
        points[:, a] += np.where(y > x, 3, x == y).astype(np.int32)

    for _, h, a, x, y in past:
        add(number[h], number[a], np.full(size, x), np.full(size, y))
    for _, h, a, x, y in ahead:
        add(number[h], number[a], draw.poisson(x, size), draw.poisson(y, size))
    position = _positions(points, gf - ga, gf, draw)
    up = position <= promoted
    if playoff and len(teams) >= promoted + playoff:
        up[np.arange(size), bracket(position, strength, promoted + 1, draw, playoff)] = True
    path = chunk * CHUNK + np.arange(size)
    return pd.DataFrame({
        "path": np.repeat(path, len(teams)), "team": np.tile(teams, size), "points": points.ravel(), "gd": (gf - ga).ravel(), "gf": gf.ravel(),
        "position": position.ravel().astype(np.int32), "champion": (position == 1).ravel().astype(float), "promoted": up.ravel().astype(float),
    })


def simulate(spark: SparkSession, fixtures: DataFrame, played: DataFrame, paths: int, seed: int = 1, promoted: int = 2, playoff: int = 4) -> DataFrame:
    """A row per path and team of a season.

    fixtures: match_id, home, away, home_rate, away_rate, still to be played; played: match_id,
    home, away, home_goals, away_goals. Played results are the same in every path. ``playoff``
    is the number of playoff places below those promoted, or 0.
    """
    if fixtures.count() + played.count() > MOST_FIXTURES:
        raise ValueError("more fixtures than a season has")
    ahead = sorted(tuple(r) for r in fixtures.select("match_id", "home", "away", "home_rate", "away_rate").collect())
    past = sorted(tuple(r) for r in played.select("match_id", "home", "away", "home_goals", "away_goals").collect())
    shared = spark.sparkContext.broadcast((ahead, past))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead, past = shared.value
        for batch in batches:
            for chunk in batch["chunk"]:
                draw = np.random.default_rng(np.random.SeedSequence([seed, int(chunk)]))
                yield _play(ahead, past, paths, int(chunk), draw, promoted, playoff)

    chunks = -(-paths // CHUNK)
    numbers = spark.range(0, chunks, 1, max(1, min(chunks, spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "chunk")
    return numbers.mapInPandas(run, PATHS)


def _chunked(rows: DataFrame, paths: int):
    """The rows of every competition once for each chunk of its paths."""
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-paths // CHUNK) - 1)))).groupBy("competition", "chunk")


def simulate_each(fixtures: DataFrame, paths: int, seed: int = 1, promoted: int = 2, playoff: int = 4) -> DataFrame:
    """``simulate`` of the seasons of all competitions, none played yet, side by side.

    fixtures has competition too, as have the rows. A task holds one competition's fixtures.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        competition, chunk = group.competition.iloc[0], int(group.chunk.iloc[0])
        ahead = sorted(group[["match_id", "home", "away", "home_rate", "away_rate"]].itertuples(index=False, name=None))
        draw = np.random.default_rng(np.random.SeedSequence([seed, chunk, zlib.crc32(competition.encode())]))
        out = _play(ahead, [], paths, chunk, draw, promoted, playoff)
        out.insert(0, "competition", competition)
        return out

    rows = fixtures.select("competition", "match_id", "home", "away", "home_rate", "away_rate")
    return _chunked(rows, paths).applyInPandas(run, f"competition string, {PATHS}")


def season_summary(paths: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(keys, team, mean_points, sd_points, champion, promoted, positions): one pass over the paths."""
    counted = paths.groupBy(*keys, "team", "position").agg(F.count("*").alias("n"), F.sum("points").alias("s"), F.sum(F.col("points") * F.col("points")).alias("q"), F.sum("champion").alias("c"), F.sum("promoted").alias("u"))
    total, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return counted.groupBy(*keys, "team").agg(
        mean.alias("mean_points"),
        F.sqrt(F.greatest(F.sum("q") / total - mean * mean, F.lit(0.0))).alias("sd_points"),
        (F.sum("c") / total).alias("champion"),
        (F.sum("u") / total).alias("promoted"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", "n")))).alias("positions"),
    )


def european_places(table: DataFrame, keys: list[str], champions: int, cup: str, league_cup: str, team: str = "team", position: str = "position") -> DataFrame:
    """The table with its competition: champions_league, europa_league, conference_league or null.

    The cup winner has the first Europa place and the league cup winner the Conference place
    unless they are placed higher; what that frees goes down the table.
    """
    top = F.col(position) <= champions
    first = Window.partitionBy(*keys, top).orderBy(F.desc(F.col(team) == F.col(cup)), position)
    rows = table.withColumn("_europa", ~top & (F.row_number().over(first) <= 2))
    last = Window.partitionBy(*keys, top | F.col("_europa")).orderBy(F.desc(F.col(team) == F.col(league_cup)), position)
    third = ~top & ~F.col("_europa") & (F.row_number().over(last) == 1)
    return rows.withColumn("europe", F.when(top, "champions_league").when(F.col("_europa"), "europa_league").when(third, "conference_league")).drop("_europa")


def _carry(states: list[tuple], paths: int, chunk: int, days: int, decay_days: float, team_sd: float, draw: np.random.Generator) -> pd.DataFrame:
    """One chunk of paths of (team, quality, quality_sd) states."""
    keep = float(np.exp(-days / decay_days))
    teams = [k[0] for k in states]
    mean, sd = np.array([k[1] for k in states]), np.array([k[2] for k in states])
    size = min(CHUNK, paths - chunk * CHUNK)
    now = mean + sd * draw.standard_normal((size, len(teams)))
    later = keep * now + team_sd * np.sqrt(1 - keep**2) * draw.standard_normal(now.shape)
    return pd.DataFrame({"path": np.repeat(chunk * CHUNK + np.arange(size), len(teams)), "team": np.tile(teams, size), "quality": later.ravel()})


def sample_states(spark: SparkSession, states: DataFrame, paths: int, days: int, decay_days: float = 700.0, team_sd: float = 0.35, seed: int = 1) -> DataFrame:
    """(path, team, quality): each path draws the teams' qualities and carries them forward.

    ``states`` has team, quality and quality_sd, a row per team. Forward in time a quality
    decays and gains the variance that keeps its long-run spread.
    """
    if states.count() > MOST_TEAMS:
        raise ValueError("more teams than a season has: use sample_states_each, by competition")
    known = sorted(tuple(r) for r in states.select("team", "quality", "quality_sd").collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch["chunk"]:
                draw = np.random.default_rng(np.random.SeedSequence([seed, 2, int(chunk)]))
                yield _carry(known, paths, int(chunk), days, decay_days, team_sd, draw)

    chunks = -(-paths // CHUNK)
    return spark.range(0, chunks, 1, max(1, min(chunks, spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "chunk").mapInPandas(run, "path long, team string, quality double")


def sample_states_each(states: DataFrame, paths: int, days: int, decay_days: float = 700.0, team_sd: float = 0.35, seed: int = 1) -> DataFrame:
    """``sample_states`` of all competitions side by side; states and rows have competition too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        competition, chunk = group.competition.iloc[0], int(group.chunk.iloc[0])
        known = sorted(group[["team", "quality", "quality_sd"]].itertuples(index=False, name=None))
        draw = np.random.default_rng(np.random.SeedSequence([seed, 2, chunk, zlib.crc32(competition.encode())]))
        out = _carry(known, paths, chunk, days, decay_days, team_sd, draw)
        out.insert(0, "competition", competition)
        return out

    return _chunked(states.select("competition", "team", "quality", "quality_sd"), paths).applyInPandas(run, "competition string, path long, team string, quality double")
