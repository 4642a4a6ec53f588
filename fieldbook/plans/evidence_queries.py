"""Queries of the evidence operators: cutoffs, current rows, snapshots, as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldbook.operators.relops import as_of_backward, first_per_key, grain_violations, latest_per_key, newest_non_null, snapshot_left_join, two_sided
from fieldbook.operators import personnel
from fieldbook.plans.registry import query
from fieldbook.session import load


@query(
    "wn01_latest_per_key",
    """SELECT user_id, event_type, event_id, ts, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
         FROM events) WHERE r = 1""",
)
def wn01(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return latest_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query(
    "ag06_newest_non_null",
    """SELECT user_id, arg_max(CASE WHEN value > 100 THEN value END, (ts, event_id)) AS big,
              arg_max(CASE WHEN event_type = 'click' THEN event_type END, (ts, event_id)) AS clicked, max(ts) AS last_ts
       FROM events GROUP BY user_id""",
)
def ag06(spark, sf):
    events = load(spark, sf, "events")
    return events.groupBy("user_id").agg(
        newest_non_null(F.when(F.col("value") > 100, F.col("value")), "ts", "event_id").alias("big"),
        newest_non_null(F.when(F.col("event_type") == "click", F.col("event_type")), "ts", "event_id").alias("clicked"),
        F.max("ts").alias("last_ts"),
    )


@query("pr03_evidence_cutoff", "SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type")
def pr03(spark, sf):
    events = load(spark, sf, "events").filter(F.col("ts") <= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("pr04_availability", "SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) + 1 <= DATE '2024-01-10'")
def pr04(spark, sf):
    # Known from the day after it on: day + 1 <= cutoff, as a bound on the column itself, so that the scan can skip.
    return load(spark, sf, "events").filter(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("event_id", "user_id")


@query(
    "pr05_training_window",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events
       WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '2024-01-13 00:00:00' AND event_type IN ('click', 'view') GROUP BY event_type HAVING count(*) >= 10""",
)
def pr05(spark, sf):
    end = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    rows = load(spark, sf, "events").filter((F.col("ts") < end) & (F.col("ts") >= end - F.expr("INTERVAL 7 DAYS")) & F.col("event_type").isin("click", "view"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).filter("n >= 10")


@query(
    "wn02_latest_snapshot",
    """SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
       FROM events WHERE event_type = 'view') WHERE r = 1""",
)
def wn02(spark, sf):
    views = load(spark, sf, "events").filter("event_type = 'view'").select("user_id", "ts", "event_id")
    return latest_per_key(views, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query(
    "wn03_latest_across_providers",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def wn03(spark, sf):
    orders = load(spark, sf, "orders")
    order = [F.desc("o_orderdate"), F.desc("o_orderpriority"), F.desc("o_orderkey")]
    return latest_per_key(orders, ["o_custkey", "o_orderstatus"], order).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query(
    "jo03_snapshot_left_join",
    """WITH s AS (SELECT user_id, ts FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r
                 FROM events WHERE event_type IN ('view', 'click')) WHERE r = 1)
       SELECT s.user_id, s.ts, e.event_id, e.value FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts = s.ts AND e.event_type = 'click'""",
)
def jo03(spark, sf):
    events = load(spark, sf, "events")
    captures = events.filter(F.col("event_type").isin("view", "click"))
    content = events.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    return snapshot_left_join(captures, ["user_id"], ["ts"], [F.desc("ts")], content, ["user_id", "ts"])


@query(
    "jo10_as_of_backward",
    """SELECT p.event_id, p.user_id, p.ts, (SELECT max(c.ts) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts < p.ts) AS click_ts
       FROM events p WHERE p.event_type = 'purchase'""",
)
def jo10(spark, sf):
    events = load(spark, sf, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return as_of_backward(bought, events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_at")), "user_id", "ts", "click_at", {"click_at": "click_ts"})


@query(
    "jo11_carry_forward",
    """WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
       SELECT p.event_id, p.user_id, arg_max(c.value, c.ts) AS carried FROM events p LEFT JOIN c ON c.user_id = p.user_id AND c.ts < p.ts
       WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id""",
)
def jo11(spark, sf):
    events = load(spark, sf, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value")
    return as_of_backward(bought, clicks, "user_id", "ts", "at", {"value": "carried"}, bucket=F.to_date).drop("ts")


@query(
    "jo12_capture_identity",
    """WITH l AS (SELECT user_id, max(struct_pack(ts := ts, e := event_id)) AS m FROM events WHERE event_type = 'signup' GROUP BY user_id)
       SELECT e.event_id, e.user_id, e.value FROM events e JOIN l ON l.user_id = e.user_id AND l.m.ts = e.ts AND l.m.e = e.event_id""",
)
def jo12(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "value", "ts", "event_type")
    latest = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("capture"))
    return events.withColumn("capture", F.struct("ts", "event_id")).join(latest, ["user_id", "capture"]).select("event_id", "user_id", "value")


@query("pr09_grain_probe", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def pr09(spark, sf):
    return grain_violations(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "wn05_first_n_per_entity",
    """SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 8""",
)
def wn05(spark, sf):
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = first_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 8)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return kept.select("o_custkey", "o_orderkey", place.alias("place"))


@query(
    "wn08_first_seen_flag",
    """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_next FROM orders WHERE o_orderstatus = 'O'""",
)
def wn08(spark, sf):
    open_orders = load(spark, sf, "orders").filter("o_orderstatus = 'O'")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1
    return open_orders.select("o_orderkey", "o_custkey", first.alias("is_next"))


@query(
    "dm04_two_sided_matches",
    """SELECT o_orderkey, 'home' AS venue, c_nationkey AS team, n_regionkey AS opponent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
       UNION ALL SELECT o_orderkey, 'away', n_regionkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def dm04(spark, sf):
    matches = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return two_sided(matches, ["o_orderkey"], {"team": "c_nationkey", "opponent": "n_regionkey"}, {"team": "n_regionkey", "opponent": "c_nationkey"})


@query(
    "dm16_membership",
    """WITH p AS (SELECT s_suppkey AS player, 't' || s_nationkey AS team FROM supplier),
       sp AS (SELECT DISTINCT l_suppkey AS player, 't' || (l_partkey % 25) AS team, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01 00:00:00'),
       tr AS (SELECT o_custkey % 10 AS player, CAST(o_orderdate AS DATE) AS d, 't' || (o_orderkey % 25) AS a, 't' || ((o_orderkey + 1 + o_custkey % 3) % 25) AS b FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'),
       own AS (SELECT p.player, p.team, max(sp.d) AS since FROM p LEFT JOIN sp ON sp.player = p.player AND sp.team = p.team GROUP BY 1, 2),
       st AS (SELECT own.player, own.team, tr.d, CASE WHEN b = own.team THEN 'member' ELSE 'departed' END AS s FROM own JOIN tr ON tr.player = own.player WHERE (since IS NULL OR tr.d > since) AND (a = own.team) <> (b = own.team)
              UNION ALL SELECT own.player, own.team, sp.d, 'departed' FROM own JOIN sp ON sp.player = own.player AND sp.team <> own.team WHERE since IS NULL OR sp.d > since),
       last AS (SELECT player, team, max(d) AS d FROM st GROUP BY 1, 2),
       dated AS (SELECT player, team, CASE WHEN min(s) = max(s) THEN min(s) ELSE 'unknown' END AS dated FROM st JOIN last USING (player, team, d) GROUP BY 1, 2),
       lists AS (SELECT s_suppkey AS player, 't' || ((s_nationkey + s_suppkey % 2) % 25) AS listed FROM supplier WHERE s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, 't' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0),
       weak AS (SELECT p.player, p.team, bool_or(listed = team) AS inside, bool_or(listed <> team) AS outside FROM p JOIN lists USING (player) GROUP BY 1, 2)
       SELECT player, team, coalesce(dated, CASE WHEN inside AND NOT outside THEN 'member' WHEN outside AND NOT inside THEN 'departed' END, 'unknown') AS membership FROM p LEFT JOIN dated USING (player, team) LEFT JOIN weak USING (player, team)""",
)
def dm16b(spark, sf):
    """Suppliers stand in for players, their parts' numbers and orders for matches and transfers."""
    team = lambda x: F.concat(F.lit("t"), x.cast("string"))
    until = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), "s_nationkey")
    lineitem, orders = load(spark, sf, "lineitem").filter(F.col("l_shipdate") <= until), load(spark, sf, "orders").filter(F.col("o_orderdate") <= until)
    spells = lineitem.select(F.col("l_suppkey").alias("player_id"), team(F.col("l_partkey") % 25).alias("team_id"), F.to_date("l_shipdate").alias("match_date")).distinct()
    moves = orders.select((F.col("o_custkey") % 10).alias("player_id"), F.to_date("o_orderdate").alias("transfer_date"), team(F.col("o_orderkey") % 25).alias("from_team_id"), team((F.col("o_orderkey") + 1 + F.col("o_custkey") % 3) % 25).alias("to_team_id"))
    squads = suppliers.filter("player_id % 5 > 0").select("player_id", team((F.col("s_nationkey") + F.col("player_id") % 2) % 25).alias("team_id"))
    fpl = suppliers.filter("player_id % 3 = 0").select("player_id", team(F.col("s_nationkey")).alias("team_id"))
    pairs = suppliers.select("player_id", team(F.col("s_nationkey")).alias("team_id"))
    found = personnel.memberships(pairs, spells, moves, squads, fpl, F.to_date(F.lit("1998-01-01")), False)
    return found.select(F.col("player_id").alias("player"), F.col("team_id").alias("team"), "membership")
