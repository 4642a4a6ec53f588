"""The canonical observation tables: columns, evidence keys, and what makes a row invalid."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Provenance columns of every table, the columns of each table, its evidence key,
# and the predicate of rows that fail a whole batch.
COMMON = "provider string, retrieved_at timestamp, evidence_basis string, source_sha256 string, normalization_version int"
COLUMNS = {
    "competition_seasons": "competition_id string, season_id string, team_ids array<string>, expected_matches int, coverage string",
    "teams": "team_id string, name string, api_id bigint",
    "fixtures": "match_id string, competition_id string, season_id string, stage string, home_team_id string, away_team_id string, match_date date, kickoff_time timestamp, status string, home_goals int, away_goals int, api_id bigint, source_row int, source_time string",
    "players": "player_id string, api_id bigint, name string, birth_date date, understat_id string, fpl_code string",
    "memberships": "player_id string, team_id string, season_id string, competition_id string, position string, basis string, scope string",
    "appearances": "match_id string, player_id string, team_id string, competition_id string, season_id string, kickoff_time timestamp, position string, starts int, minutes int, goals int, assists int, shots int, shots_on_target int, saves int, yellow_cards int, red_cards int, rating double, passes_total int, key_passes int, pass_accuracy string, tackles int, interceptions int, duels_total int, duels_won int, dribbles_attempted int, dribbles_successful int, fouls_drawn int, fouls_committed int",
    "availability": "player_id string, fpl_code string, team_id string, competition_id string, season_id string, match_id string, scope string, status string, reason string, start_date date, end_date date, chance_this_round int, chance_next_round int, current_round int, next_round int, news_added timestamp",
    "transfers": "player_id string, transfer_date date, from_team_id string, to_team_id string, transfer_type string",
    "team_process": "match_id string, team_id string, competition_id string, season_id string, xg double, shots int, shots_on_target int, source_match_id string",
    "player_process": "match_id string, team_id string, player_id string, understat_id string, competition_id string, season_id string, position string, minutes int, xg double, xa double, shots int",
    "odds": "match_id string, competition_id string, season_id string, family string, home_odds double, draw_odds double, away_odds double, observed_at timestamp",
    "kalshi_markets": "market_ticker string, event_ticker string, series_ticker string, competition_id string, season_id string, family string, family_detail string, epl_family string, title string, market_type string, status string, result string, yes_label string, no_label string, team_id string, match_id string, side string, yes_bid decimal(10,4), yes_ask decimal(10,4), no_bid decimal(10,4), no_ask decimal(10,4), last_price decimal(10,4), previous_yes_bid decimal(10,4), previous_yes_ask decimal(10,4), previous_price decimal(10,4), liquidity decimal(18,4), yes_bid_size decimal(18,2), yes_ask_size decimal(18,2), volume decimal(18,2), volume_24h decimal(18,2), open_interest decimal(18,2), can_close_early boolean, price_ranges string, open_time timestamp, close_time timestamp, created_time timestamp, updated_time timestamp, occurrence_datetime timestamp, latest_expiration_time timestamp",
    "team_statistics": "match_id string, team_id string, competition_id string, season_id string, expected_goals double, goals_prevented double, shots_total int, shots_on_goal int, shots_off_goal int, shots_blocked int, shots_inside_box int, shots_outside_box int, corners int, offsides int, fouls int, yellow_cards int, red_cards int, goalkeeper_saves int, passes_total int, passes_accurate int, possession double, api_id bigint",
    "standings": "competition_id string, season_id string, team_id string, rank int, points int, played int, wins int, draws int, losses int, goals_for int, goals_against int, goal_difference int, group_name string, description string, updated_at timestamp",
    "source_snapshots": "scope_kind string, scope_key string, endpoint string, competition_id string, season_id string, team_id string, match_id string, row_count int",
}
KEYS = {
    "competition_seasons": ["competition_id", "season_id"],
    "teams": ["team_id"],
    "fixtures": ["match_id"],
    "players": ["player_id"],
    "memberships": ["player_id", "team_id", "season_id", "basis"],
    "appearances": ["match_id", "player_id", "team_id"],
    "availability": ["player_id", "fpl_code", "scope", "status", "start_date", "reason"],
    "transfers": ["player_id", "transfer_date", "from_team_id", "to_team_id", "transfer_type"],
    "team_process": ["match_id", "team_id"],
    "player_process": ["match_id", "understat_id"],
    "odds": ["match_id", "family"],
    "kalshi_markets": ["market_ticker"],
    "team_statistics": ["match_id", "team_id"],
    "standings": ["competition_id", "season_id", "team_id"],
    "source_snapshots": ["scope_kind", "scope_key"],
}
_PRICES = "yes_bid, yes_ask, no_bid, no_ask, last_price, previous_yes_bid, previous_yes_ask, previous_price"
INVALID = {
    "fixtures": "home_team_id is null or away_team_id is null or home_team_id = away_team_id or (status = 'finished' and (home_goals is null or away_goals is null or least(home_goals, away_goals) < 0))",
    "appearances": "player_id is null or minutes not between 0 and 120 or starts not in (0, 1)",
    "players": "player_id is null",
    "team_process": "xg < 0 or isnan(xg) or xg = double('infinity') or least(shots, shots_on_target) < 0 or shots_on_target > shots",
    "player_process": "least(xg, xa) < 0 or isnan(xg) or isnan(xa) or greatest(xg, xa) = double('infinity')",
    "odds": "least(home_odds, draw_odds, away_odds) <= 1 or isnan(home_odds + draw_odds + away_odds) or greatest(home_odds, draw_odds, away_odds) = double('infinity')",
    "kalshi_markets": f"market_ticker is null or least({_PRICES}) < 0 or greatest({_PRICES}) > 1 or least(liquidity, yes_bid_size, yes_ask_size, volume, volume_24h, open_interest) < 0",
    "team_statistics": "team_id is null or match_id is null or least(expected_goals, shots_total, shots_on_goal, possession) < 0 or possession > 100 or shots_on_goal > shots_total or passes_accurate > passes_total",
    "standings": "team_id is null or rank < 1 or least(played, wins, draws, losses, goals_for, goals_against) < 0 or wins + draws + losses <> played or goal_difference <> goals_for - goals_against",
    "source_snapshots": "scope_kind is null or scope_key is null or endpoint is null or row_count < 0",
}


def schema(table: str) -> StructType:
    if table not in COLUMNS:
        raise ValueError(f"unknown canonical table {table}")
    return StructType.fromDDL(f"{COLUMNS[table]}, {COMMON}")
