"""Personnel evidence against a plain version, on small random seasons."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import personnel as P

UTC = timezone.utc
CUTOFF = datetime(2025, 12, 1, 12, tzinfo=UTC)
TEAMS = ["a", "b", "c"]


def season(seed):
    draw = random.Random(seed)
    players = {t: [f"{t}{k}" for k in range(14)] for t in TEAMS}
    seen, finished = [], []
    for k in range(26):
        home, away = draw.sample(TEAMS, 2)
        kickoff = datetime(2025, 9, 1, 15, tzinfo=UTC) + timedelta(days=3 * k)
        finished.append((f"m{k:02d}", kickoff.date(), kickoff if draw.random() < 0.9 else None, home, away))
        for team in (home, away):
            squad = draw.sample(players[team], 12) + draw.sample(players[draw.choice(TEAMS)], draw.choice([0, 0, 0, 1]))
            captures = draw.choice([1, 1, 2])
            for capture in range(captures):
                empty, sha = capture == 1 and draw.random() < 0.3, f"s{draw.randint(0, 9)}"
                for n, p in enumerate(dict.fromkeys(squad)):
                    minutes = None if empty or n > 11 else (90 if n < 9 else draw.choice([None, 40, 95]))
                    seen.append((f"m{k:02d}", team, p, int(n < 11), minutes, kickoff, kickoff.date(), kickoff + timedelta(hours=3 + capture), sha))
    fixtures = [("x1", draw.choice(["eng-premier-league", "other"]), date(2025, 12, 3), datetime(2025, 12, 3, 15, tzinfo=UTC), "a", "b"), ("x2", "other", date(2025, 12, 5), datetime(2025, 12, 5, 15, tzinfo=UTC), "c", "a"), ("far", "other", date(2025, 12, 20), datetime(2025, 12, 20, 15, tzinfo=UTC), "b", "c")]
    for n, p in enumerate(players["c"] + players["b"][:5]):  # a sheet before kick-off
        if draw.random() < 0.95:
            seen.append(("x2", "c", p, int(n < 11), None, fixtures[1][3], date(2025, 12, 5), datetime(2025, 12, 1, 11, tzinfo=UTC), "sheet"))
    moves = [(draw.choice(players[draw.choice(TEAMS)]), date(2025, 11, draw.randint(1, 30)), draw.choice([*TEAMS, None]), draw.choice([*TEAMS, None, "z"]), CUTOFF - timedelta(days=draw.choice([1, 1, -1]))) for _ in range(14)]
    squads = [(t, p) for t in TEAMS for p in players[t] if draw.random() < 0.7] + [("b", "a1")]
    fpl = [(p, draw.choice([t, t, "z"]), draw.choice("aaddisx")) for t in TEAMS for p in players[t] if draw.random() < 0.5]
    injuries = [(m, t, draw.choice(players[t]), draw.choice(["unavailable", "doubtful", "doubtful", "odd"])) for m, t in (("x1", "a"), ("x1", "b"), ("x2", "a")) for _ in range(3)]
    return fixtures, finished, seen, moves, squads, fpl, injuries


def plain(fixtures, finished, seen, moves, squads, fpl, injuries):
    """Rows one by one, from the rules."""
    captures = defaultdict(list)
    for row in seen:
        captures[row[0], row[1], row[7], row[8]].append(row)
    squad, sheet = {}, {}
    for (m, t, at, sha), rows in captures.items():
        if rows[0][5] < CUTOFF and any(r[4] is not None for r in rows) and (m, t) not in squad or (m, t) in squad and rows[0][5] < CUTOFF and any(r[4] is not None for r in rows) and (at, sha) > squad[m, t][0]:
            squad[m, t] = (at, sha), {r[2]: r[4] for r in rows}
        if at < rows[0][5] and sum(r[3] for r in rows) == 11 and len(rows) >= 18 and (at, sha) > sheet.get((m, t), ((datetime.min.replace(tzinfo=UTC), ""),))[0]:
            sheet[m, t] = (at, sha), {r[2] for r in rows}
    day_of = {f[0]: f[1] for f in finished}
    spells = {(p, t, day_of[m]) for (m, t), (_, rows) in squad.items() for p in rows}
    teams, out = {}, {}
    for match, competition, on, kickoff, home, away in fixtures:
        if not CUTOFF < kickoff <= CUTOFF + timedelta(days=6):
            continue
        for name, team in (("home", home), ("away", away)):
            past = sorted((d, m) for m, d, k, h, a in finished if team in (h, a) and d < on and (k or datetime(d.year, d.month, d.day, tzinfo=UTC) + timedelta(days=1)) < CUTOFF)[-8:]
            rows = [squad.get((m, team), (None, {}))[1] for _, m in past]
            if len(rows) < 8 or any(sum(min(x, 90) for x in r.values() if x is not None) < 700 for r in rows):
                teams[match, name] = (None, None)
                continue
            weight = defaultdict(int)
            for r in rows:
                for p, x in r.items():
                    if x is not None:
                        weight[p] += min(x, 90)
            resolved = represented = 0.0
            for p, w in weight.items():
                since = max((d for q, t, d in spells if (q, t) == (p, team)), default=None)
                strong = [(d, "member" if b == team else "departed") for q, d, a, b, at in moves if q == p and at <= CUTOFF and d <= CUTOFF.date() and (since is None or d > since) and (a == team) != (b == team)]
                strong += [(d, "departed") for q, t, d in spells if q == p and t != team and (since is None or d > since)]
                weak = {"member" if t == team else "departed" for t, q in squads if q == p} | {"member" if t == team else "departed" for q, t, _ in fpl if q == p}
                last = {s for d, s in strong if d == max(x for x, _ in strong)}
                state = (last if len(last) == 1 else {"unknown"}) if strong else weak if len(weak) == 1 else {"unknown"}
                state = next(iter(state))
                own = next((s for q, t, s in fpl if q == p and t == team), None)
                values = [P.API_STATUS.get(s) for m, t, q, s in injuries if (m, t, q) == (match, team, p)]
                if competition == P.FPL_COMPETITION and own is not None:
                    fit = P.FPL_STATUS.get(own)
                else:
                    fit = None if None in values else min(values, default=1.0)
                chosen = [p in r for r in rows]
                if (match, team) in sheet:
                    prob = float(p in sheet[match, team][1])
                elif state == "departed":
                    prob = 0.0
                elif state == "member" and fit is not None:
                    prob = fit * P.PROPENSITY[sum(chosen), chosen[-1]]
                else:
                    prob = None
                out[match, name, p] = (w, state, prob)
                if prob is not None:
                    resolved, represented = resolved + w, represented + w * prob
            total = sum(weight.values())
            teams[match, name] = (1 - represented / resolved if resolved else None, 1 - resolved / total)
    shift = {}
    for match in {m for m, _ in teams}:
        d = [teams[match, s][0] if teams[match, s][0] is not None and teams[match, s][1] <= 0.25 else None for s in ("home", "away")]
        shift[match] = None if None in d else P.KAPPA * (d[1] - d[0])
    return teams, out, shift


def run(spark, fixtures, finished, seen, moves, squads, fpl, injuries):
    make = spark.createDataFrame
    games = "match_id string, {c}match_date date, kickoff_time timestamp, home_team_id string, away_team_id string"
    return P.personnel(
        make(fixtures, games.format(c="competition_id string, ")),
        make(finished, games.format(c="")),
        make(seen, "match_id string, team_id string, player_id string, starts int, minutes int, kickoff_time timestamp, match_date date, retrieved_at timestamp, source_sha256 string"),
        make(moves, "player_id string, transfer_date date, from_team_id string, to_team_id string, retrieved_at timestamp"),
        make(squads, "team_id string, player_id string"),
        make(fpl, "player_id string, team_id string, status string"),
        make(injuries, "match_id string, team_id string, player_id string, status string"),
        CUTOFF,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    data = season(seed)
    teams, players, shift = plain(*data)
    got_teams, got_players, got_shift = run(spark, *data)
    side = got_teams.select("match_id", "team_id", "side")
    found = {(r.match_id, r.side, r.player_id): (r.weight, r.membership, r.probability) for r in got_players.join(side, ["match_id", "team_id"]).collect()}
    assert found.keys() == players.keys() and len(found) > 20
    for key, (weight, state, p) in players.items():
        assert found[key][:2] == (weight, state), key
        assert found[key][2] == (None if p is None else pytest.approx(p)), key
    for r in got_teams.collect():
        d, u = teams[r.match_id, r.side]
        assert (r.discontinuity, r.unresolved_weight) == (None if d is None else pytest.approx(d), None if u is None else pytest.approx(u))
    assert {r.match_id: r.home_log_rate_shift for r in got_shift.collect()} == {m: None if x is None else pytest.approx(x) for m, x in shift.items()}


def test_later_rows_change_nothing(spark):
    fixtures, finished, seen, moves, *rest = season(1)
    want = sorted(map(tuple, run(spark, fixtures, finished, seen, moves, *rest)[2].collect()))
    later = CUTOFF + timedelta(hours=1)
    more = [(*r[:7], later, "z") for r in seen[:40]]
    moved = [("a1", date(2025, 12, 1), "a", "b", later)]
    assert sorted(map(tuple, run(spark, fixtures, finished, [*more, *reversed(seen)], [*moved, *moves], *rest)[2].collect())) == want


def test_nothing_known_leaves_members(spark):
    pairs = spark.createDataFrame([("p", "a")], "player_id string, team_id string")
    none = spark.createDataFrame([], "player_id string, team_id string")
    spells = none.withColumn("match_date", F.lit(None).cast("date"))
    moves = spark.createDataFrame([], "player_id string, transfer_date date, from_team_id string, to_team_id string")
    state = lambda known: P.memberships(pairs, spells, moves, none, none, F.lit(date(2025, 1, 1)), known).first().membership
    assert (state(True), state(False)) == ("member", "unknown")
