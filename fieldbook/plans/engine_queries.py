"""Queries of the evidence store, sources and sinks, streams, models and simulation."""

from __future__ import annotations

import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import probability as P
from fieldbook.functions import scoring as S
from fieldbook.operators import models, simulate
from fieldbook.operators.relops import digest, latest_per_key
from fieldbook.operators.verify import unpublishable
from fieldbook.plans.namespace import Namespace, Relation
from fieldbook.plans.relational_queries import DIGEST_SUMS, digest_line
from fieldbook.plans.registry import query
from fieldbook.session import load, scratch
from fieldbook.sources import evidence, files
from fieldbook.streaming import incremental

WEEKS = (8, 15, 22, 31)


def _request(day: int) -> dict:
    return {"provider": "feed", "retrieved_at": f"2024-01-{day:02d}T00:00:00+00:00", "evidence_basis": "observed", "source_sha256": f"{day:064d}"}


def _week(spark, sf, k: int):
    """The last event of every user in a week, as rows of the canonical ``teams``."""
    first = WEEKS[k - 1] if k else 1
    rows = load(spark, sf, "events").filter((F.dayofmonth("ts") >= first) & (F.dayofmonth("ts") < WEEKS[k]))
    last = latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.select(F.col("user_id").cast("string").alias("team_id"), F.col("event_type").alias("name"), F.col("event_id").alias("api_id"))


def _store(spark, sf, weeks=range(4), label="store"):
    root = scratch(spark, label)
    return root, evidence.publish_all(spark, root, [(_request(WEEKS[k]), {"teams": _week(spark, sf, k)}) for k in weeks])


WEEKLY = """WITH e AS (SELECT *, CASE WHEN dayofmonth(ts) < 8 THEN 8 WHEN dayofmonth(ts) < 15 THEN 15 WHEN dayofmonth(ts) < 22 THEN 22 ELSE 31 END AS seen FROM events WHERE dayofmonth(ts) < 31),
  w AS (SELECT CAST(user_id AS VARCHAR) AS team_id, event_type AS name, event_id AS api_id, seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seen ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1)"""


@query("sc01_manifest_scan", WEEKLY + " SELECT team_id, name, api_id, CAST(seen AS INTEGER) AS seen FROM w")
def sc01(spark, sf):
    root, _ = _store(spark, sf)
    rows = evidence.Dataset(spark, root, tables=["teams"]).observations("teams")
    return rows.select("team_id", "name", "api_id", F.dayofmonth("retrieved_at").alias("seen"))


@query("sc05_current_at_cutoff", WEEKLY + " SELECT team_id, name, api_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY seen DESC) AS r FROM w WHERE seen <= 22) WHERE r = 1")
def sc05(spark, sf):
    root, _ = _store(spark, sf)
    return evidence.Dataset(spark, root, "2024-01-22T00:00:00+00:00", tables=["teams"]).current("teams").select("team_id", "name", "api_id")


@query("sc04_workspace_overlay", WEEKLY + " SELECT team_id, name, api_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY seen DESC) AS r FROM w WHERE seen < 31) WHERE r = 1")
def sc04(spark, sf):
    root, _ = _store(spark, sf, range(0, 2))
    workspace, _ = _store(spark, sf, range(1, 3), "workspace")  # its first batch is known already
    data = evidence.Dataset(spark, root, workspace=workspace, tables=["teams"])
    return data.current("teams").select("team_id", "name", "api_id")


@query("sk04_compaction", WEEKLY + " SELECT team_id, name, api_id, CAST(seen AS INTEGER) AS seen FROM w")
def sk04(spark, sf):
    root, manifests = _store(spark, sf)
    base = evidence.compact(spark, root, manifests, ["teams"])
    rows = evidence.Dataset(spark, root, tables=["teams"], manifests=[base]).observations("teams")
    return rows.select("team_id", "name", "api_id", F.dayofmonth("retrieved_at").alias("seen"))


@query("sk01_sorted_parquet", "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sk01(spark, sf):
    path = scratch(spark, "parquet")
    load(spark, sf, "nation").repartition("n_regionkey").sortWithinPartitions("n_name").write.option("compression", "zstd").partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).filter("n_regionkey = 2").select("n_regionkey", "n_nationkey", "n_name")


@query("sc06_csv_source", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INTEGER) AS source_row FROM nation")
def sc06(spark, sf):
    rows = load(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # a dimension of 25 rows
    path = f"{scratch(spark, 'csv')}/nation.csv"
    files.write_once(spark, path, "﻿key,name\n" + "".join(f"{k},{n}\n" for k, n in rows))
    return files.csv_rows(spark, path, ["key", "name"])


@query("sc07_json_documents", "SELECT r_regionkey AS id, r_name AS name FROM region")
def sc07(spark, sf):
    folder = scratch(spark, "json")
    for r in load(spark, sf, "region").collect():  # five rows
        files.write_once(spark, f"{folder}/{r.r_regionkey}.json", json.dumps({"id": r.r_regionkey, "name": r.r_name}))
    return files.json_documents(spark, folder, "id int, name string")


@query("sc09_pointer_documents", "SELECT r_regionkey AS id, r_name AS name, 'v1' AS version FROM region WHERE r_regionkey < 3")
def sc09(spark, sf):
    folder = scratch(spark, "documents")
    listed = []
    for r in load(spark, sf, "region").collect():
        files.write_once(spark, f"{folder}/d/{r.r_regionkey}.json", json.dumps({"version": "v1", "id": r.r_regionkey, "name": r.r_name}))
        listed += [f"d/{r.r_regionkey}.json"] * (r.r_regionkey < 3)
    files.update_pointer(spark, f"{folder}/index", lambda _: {"version": "v1", "documents": listed})
    index = files.read_pointer(spark, f"{folder}/index")
    rows = spark.read.schema("version string, id int, name string").json([f"{folder}/{d}" for d in index["documents"]])
    return rows.filter(F.col("version") == index["version"])


@query("sc11_in_memory_relation", "SELECT * FROM (VALUES (1, 'home'), (2, 'draw'), (3, NULL)) AS t(id, outcome)")
def sc11(spark, sf):
    return spark.createDataFrame([(1, "home"), (2, "draw"), (3, None)], "id int, outcome string")


@query(
    "sc12_column_catalog",
    "SELECT table_name AS object_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')",
)
def sc12(spark, sf):
    space = _namespace(spark, sf)
    return space.column_catalog().filter(F.col("object_name").isin("region", "nation", "customer")).select("object_name", "column_name", "ordinal")


def _namespace(spark, sf):
    about = {"region": ("region", "Regions."), "nation": ("nation", "Nations of a region."), "customer": ("customer", "Customers and their balance."), "events": ("event", "Events of users; ts is when it was seen.")}
    return Namespace(spark, [Relation(n, g, m, load(spark, sf, n), "ts: transaction time" if n == "events" else "") for n, (g, m) in about.items()])


@query("ud03_namespace_sql", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 1000.0 GROUP BY r_name")
def ud03(spark, sf):
    text = """SELECT r_name, count(*) AS customers FROM analysis_customer JOIN analysis_nation ON n_nationkey = c_nationkey
              JOIN analysis_region ON r_regionkey = n_regionkey WHERE c_acctbal > :least GROUP BY r_name"""
    return _namespace(spark, sf).sql(text, {"least": 1000.0})


@query("ud04_bounded_query", "SELECT 'nations' AS name, 25 AS total, true AS truncated, 10 AS shown")
def ud04(spark, sf):
    found = _namespace(spark, sf).bounded({"nations": "SELECT n_name FROM analysis_nation ORDER BY n_name"}, max_rows=10)["nations"]
    return spark.createDataFrame([("nations", load(spark, sf, "nation").count(), found["truncated"], len(found["rows"]))], "name string, total int, truncated boolean, shown int")


@query("ud05_catalog_search", "SELECT 'customer' AS object_name, 'customer' AS grain")
def ud05(spark, sf):
    return _namespace(spark, sf).search("customers balance").select("object_name", "grain")


@query(
    "sc13_log_metrics",
    """SELECT event_type AS method, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'view' THEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) ELSE 0 END) AS BIGINT) AS response_bytes FROM events GROUP BY event_type""",
)
def sc13(spark, sf):
    size = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("requests"), F.sum(F.when(F.col("event_type") == "view", size).otherwise(0)).alias("response_bytes"))


@query("sk06_csv_sink", "SELECT * FROM (VALUES ('1', 'x', NULL), ('2', NULL, 'y')) AS t(a, b, c)")
def sk06(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv([{"a": 1, "b": "x"}, {"a": 2, "c": "y"}], spark, path)
    return spark.read.csv(path, header=True, schema="a string, b string, c string")


@query("sk08_document_tree", "SELECT n_regionkey, count(*) AS documents, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def sk08(spark, sf):
    path = scratch(spark, "documents")
    load(spark, sf, "nation").write.partitionBy("n_regionkey").json(path)
    rows = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("documents"), F.min("n_name").alias("first_name"))


# --- tables changed by statements


@query("dd02_insert_by_name", "SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def dd02(spark, sf):
    path = scratch(spark, "table")
    target = "id int, name string, note string"
    for rows in (load(spark, sf, "nation").selectExpr("n_name AS name", "n_nationkey AS id"), load(spark, sf, "region").selectExpr("'region' AS note", "r_name AS name", "r_regionkey AS id")):
        spark.createDataFrame([], target).unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(path)
    return spark.read.schema(target).parquet(path)


@query("dd03_update_from", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, n_name) AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dd03(spark, sf):
    rows = load(spark, sf, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rows.join(nation, "c_nationkey", "left").select("c_custkey", F.coalesce("segment", "n_name").alias("segment"))


@query("dd04_delete_where_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) ORDER BY d DESC, o_custkey OFFSET 8)")
def dd04(spark, sf):
    orders = load(spark, sf, "orders")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("d")).orderBy(F.desc("d"), "o_custkey").limit(8)
    return orders.join(F.broadcast(newest), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("dd05_evolved_schema", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS added FROM nation UNION ALL SELECT r_regionkey, r_name, CAST(r_regionkey AS DOUBLE) FROM region")
def dd05(spark, sf):
    path = scratch(spark, "table")
    load(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name").write.parquet(f"{path}/old")
    load(spark, sf, "region").selectExpr("r_regionkey AS id", "r_name AS name", "double(r_regionkey) AS added").write.parquet(f"{path}/new")
    return spark.read.schema("id int, name string, added double").parquet(f"{path}/old", f"{path}/new")


# --- streams


@query("st01_incremental_current_view", "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def st01(spark, sf):
    root = scratch(spark, "stream")
    events = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    events.repartition(3, "event_id").write.parquet(f"{root}/in")
    stream = incremental.read_events(spark, f"{root}/in", events.schema)
    return incremental.run_current_view(stream, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], root)


@query("st00_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st00(spark, sf):
    root = scratch(spark, "stream")
    events = load(spark, sf, "events").select("ts", "event_type")
    events.repartition(2).write.parquet(f"{root}/in")
    counts = incremental.run_window_counts(incremental.read_events(spark, f"{root}/in", events.schema), "ts", "1 day", "2 days", ["event_type"], root)
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "st02_change_detection",
    f"""SELECT event_type, count(*) AS n, {DIGEST_SUMS} FROM (SELECT DISTINCT event_type, sha256({digest_line(["user_id", "event_type"])}) AS h FROM events) GROUP BY event_type""",
)
def st02(spark, sf):
    # Identity of what is known, not of when it was seen: times are left out and repeats drop.
    known = load(spark, sf, "events").select("user_id", "event_type").distinct()
    return known.groupBy("event_type").agg(*digest(known, ["user_id", "event_type"]))


@query(
    "st06_due_rules",
    """SELECT event_id, CASE WHEN age < 0 THEN 'line_ups' WHEN age < 2 THEN 'in_play' WHEN age < 26 THEN 'first_correction' WHEN age < 74 THEN 'second_correction' ELSE 'settled' END AS due
       FROM (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') / 3600.0 AS age FROM events)""",
)
def st06(spark, sf):
    age = (F.unix_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600.0
    due = F.when(age < 0, "line_ups").when(age < 2, "in_play").when(age < 26, "first_correction").when(age < 74, "second_correction").otherwise("settled")
    return load(spark, sf, "events").select("event_id", due.alias("due"))


@query("st07_complete_pages_only", "SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = max(turn) - min(turn) + 1")
def st07(spark, sf):
    pages = load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"), F.countDistinct("turn").alias("seen"), (F.max("turn") - F.min("turn") + 1).alias("wanted"))
    return pages.filter("seen = wanted").select("conv_id", "pages")


# --- models and simulation, on matches between nations


BLOCK = 8000


def _league(spark, sf):
    """A match per order: the customer's nation at home, another away, goals from its numbers.

    Every ``BLOCK`` order keys are two competitions, so a competition has a bounded number of
    matches however many orders there are.
    """
    orders = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    away = (F.col("c_nationkey") + 1 + F.col("o_orderkey") % 11) % 12
    home = F.col("c_nationkey") % 12
    strength = F.pmod(F.xxhash64("o_orderkey"), F.lit(4))
    rows = orders.select(
        F.concat_ws(":", F.lit("m"), F.col("o_orderkey").cast("string")).alias("match_id"),
        F.concat_ws("-", F.when(F.col("c_nationkey") < 12, "north").otherwise("south"), F.floor(F.col("o_orderkey") / BLOCK).cast("string")).alias("competition"),
        F.date_add(F.lit("2020-08-01").cast("date"), (F.col("o_orderkey") % 700).cast("int")).alias("match_date"),
        home.cast("string").alias("home"),
        F.when(away == home, (home + 1) % 12).otherwise(away).cast("string").alias("away"),
        F.floor((strength + home % 3) / 2).cast("int").alias("home_goals"),
        F.pmod(F.xxhash64("o_orderkey", "o_custkey"), F.lit(3)).cast("int").alias("away_goals"),
    )
    return rows


def _origins(league, days):
    """Every competition of the league at each of the days, an expression for an array of dates."""
    return league.select("competition").distinct().withColumn("as_of", F.explode(F.expr(days)))


DECEMBER = "array(DATE'2021-12-01')"


#: The league without its scores, which are hashes: what SQL can say of the models' results.
LEAGUE = f"""WITH l AS (SELECT CASE WHEN c_nationkey < 12 THEN 'north' ELSE 'south' END || '-' || (o_orderkey // {BLOCK}) AS competition, DATE '2020-08-01' + CAST(o_orderkey % 700 AS INTEGER) AS match_date, c_nationkey % 12 AS home, (c_nationkey + 1 + o_orderkey % 11) % 12 AS other
    FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT competition, match_date, CAST(home AS VARCHAR) AS home, CAST(CASE WHEN other = home THEN (home + 1) % 12 ELSE other END AS VARCHAR) AS away FROM l),
  t AS (SELECT competition, match_date, home AS team FROM m UNION ALL SELECT competition, match_date, away FROM m)"""


def _kept(rows, label):
    """Results of Python workers as a written table: they are looked at more than once."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query(
    "dm17_attack_defence_fit",
    LEAGUE + " SELECT competition, count(DISTINCT team) AS teams, count(*) // 2 AS matches, true AS centred, true AS gradient_vanishes FROM t WHERE match_date < DATE '2021-12-01' GROUP BY competition",
)
def dm17(spark, sf):
    """A fit is right if the slope of its penalised likelihood is zero in every team's effects."""
    league, ridge = _league(spark, sf), 5.0
    origins = _origins(league, DECEMBER)
    ratings = _kept(models.fit_ratings(league, origins, ridge=ridge), "ratings")
    rows = models.training_rows(league, origins, 0)
    keys = ["match_id", "competition", "as_of", "home", "away"]
    weight = F.pow(F.lit(2.0), -F.datediff("as_of", "match_date") / F.lit(365.0))
    side = lambda own, other: F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), (weight * (F.col(f"{own}_rate") - F.col(f"{own}_goals"))).alias("gap"))
    gaps = models.predict(rows.select(keys), ratings).join(rows, keys).select("competition", F.inline(F.array(side("home", "away"), side("away", "home"))))
    scored = gaps.groupBy("competition", "team").agg(F.sum("gap").alias("scored"))
    conceded = gaps.groupBy("competition", F.col("opponent").alias("team")).agg(F.sum("gap").alias("conceded"))
    all_teams = Window.partitionBy("competition")
    slopes = ratings.join(scored, ["competition", "team"], "left").join(conceded, ["competition", "team"], "left").fillna(0.0, ["scored", "conceded"])
    # The design is centred, so that a team's slope is its own sum less the mean of all.
    attack = F.col("scored") - F.avg("scored").over(all_teams) + ridge * F.col("attack")
    defense = F.avg("conceded").over(all_teams) - F.col("conceded") + ridge * F.col("defense")
    slopes = slopes.withColumn("slope", F.greatest(F.abs(attack), F.abs(defense)))
    return slopes.groupBy("competition").agg(
        F.count("*").alias("teams"),
        (F.sum("matches") / 2).cast("long").alias("matches"),
        ((F.abs(F.sum("attack")) < 1e-6) & (F.abs(F.sum("defense")) < 1e-6)).alias("centred"),
        (F.max("slope") < 1e-4).alias("gradient_vanishes"),
    )


@query(
    "dm18_daily_filter_states",
    LEAGUE + " SELECT competition, member, count(DISTINCT team) AS teams, date_diff('day', DATE '1970-01-01', max(match_date)) AS last_day, true AS proper FROM t, (VALUES ('calm'), ('lively'), ('usual')) AS v(member) GROUP BY competition, member",
)
def dm18(spark, sf):
    """States know every team up to the last day, and are surer of none than of a new one."""
    members = {"calm": {"team_sd": 0.2}, "usual": {"team_sd": 0.35}, "lively": {"team_sd": 0.5}}
    states = models.filter_states(_league(spark, sf), members)
    new = F.element_at(F.create_map(*[F.lit(x) for m, o in members.items() for x in (m, o["team_sd"])]), F.col("member"))
    proper = F.col("quality_sd").between(1e-6, new) & (F.abs("quality") < 5) & (F.col("evidence") < 0)
    return states.groupBy("competition", "member").agg(F.count("*").alias("teams"), F.max("as_of_day").alias("last_day"), F.bool_and(proper).alias("proper"))


@query(
    "dm30_rolling_backtest",
    LEAGUE + ", o AS (SELECT CAST(unnest(range(DATE '2021-06-01', DATE '2022-05-02', INTERVAL 2 MONTH)) AS DATE) AS as_of) SELECT competition, as_of, count(*) AS n, true AS proper FROM m JOIN o ON match_date >= as_of AND match_date < as_of + 30 GROUP BY competition, as_of",
)
def dm30(spark, sf):
    """Every match within a month of an origin is predicted, and its three outcomes add up."""
    league = _league(spark, sf)
    rows = models.backtest(league, _origins(league, "sequence(DATE'2021-06-01', DATE'2022-05-01', INTERVAL 2 MONTHS)"), horizon_days=30)
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), 0).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(2)
    keys = ["match_id", "competition", "as_of", "outcome"]
    sums = P.outcome_sums(P.score_grid(rows.withColumn("outcome", outcome), keys, F.col("home_rate"), F.col("away_rate")), keys)
    p = F.when(F.col("outcome") == 0, F.col("p_home")).when(F.col("outcome") == 1, F.col("p_draw")).otherwise(F.col("p_away"))
    proper = (F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) < 1e-4) & S.log_loss(p).between(0, 5)
    return sums.groupBy("competition", "as_of").agg(F.count("*").alias("n"), F.bool_and(proper).alias("proper"))


@query(
    "dm23_season_simulation",
    LEAGUE + """, s AS (SELECT competition, count(DISTINCT team) AS teams FROM t WHERE match_date < DATE '2021-12-01' GROUP BY competition)
    SELECT competition, teams, 2000 AS paths, 1.0::DOUBLE AS champion, CASE WHEN teams >= 6 THEN 3.0 ELSE least(2, teams) END::DOUBLE AS promoted, true AS conserved FROM s""",
)
def dm23(spark, sf):
    """In every path each place is taken once, goals cancel out, and a match gives two or three points."""
    league = _league(spark, sf)
    ratings = _kept(models.fit_ratings(league, _origins(league, DECEMBER)), "ratings")
    teams = ratings.select("competition", "as_of", F.col("team").alias("home"))
    fixtures = teams.join(teams.withColumnRenamed("home", "away"), ["competition", "as_of"]).filter("home <> away").withColumn("match_id", F.concat_ws("-", "home", "away"))
    paths = _kept(simulate.simulate_each(models.predict(fixtures, ratings), 2000, seed=11), "paths")
    each = paths.groupBy("competition", "path").agg(F.count("*").alias("teams"), F.countDistinct("position").alias("places"), F.sum("gd").alias("gd"), F.sum("points").alias("points"))
    games = F.col("teams") * (F.col("teams") - 1)
    sound = (F.col("places") == F.col("teams")) & (F.col("gd") == 0) & F.col("points").between(2 * games, 3 * games)
    checked = each.groupBy("competition").agg(F.max("teams").alias("teams"), F.count("*").cast("int").alias("paths"), F.bool_and(sound).alias("conserved"))
    summary = simulate.season_summary(paths, ["competition"]).groupBy("competition").agg(F.round(F.sum("champion"), 9).alias("champion"), F.round(F.sum("promoted"), 9).alias("promoted"))
    return checked.join(summary, "competition").select("competition", "teams", "paths", "champion", "promoted", "conserved")


@query(
    "dm11_gamma_poisson",
    """WITH r AS (SELECT n_nationkey AS k, 1.5 + (n_nationkey % 7) / 4.0 AS m, CAST(8.0 AS DOUBLE) AS s FROM nation),
       p AS (SELECT k, g, exp(lgamma(g + s) - lgamma(s) - lgamma(g + 1.0) + s * ln(s / (s + m)) + g * ln(m / (s + m))) AS p FROM r, range(0, 13) t(g))
       SELECT k, CAST(g AS INTEGER) AS goals, round(p, 8) AS p FROM p""",
)
def dm11(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.lit(1.5) + (F.col("n_nationkey") % 7) / F.lit(4.0)).alias("m"))
    return rows.select("k", "m", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("goals")).select("k", "goals", F.round(P.gamma_poisson_pmf(F.col("goals"), F.col("m"), 8.0), 8).alias("p"))


@query(
    "dm12_score_mixture",
    """WITH r AS (SELECT n_nationkey AS k, 0.8 + (n_nationkey % 5) / 5.0 AS l FROM nation), c(w, f) AS (VALUES (0.5::DOUBLE, 0.8::DOUBLE), (0.3::DOUBLE, 1.0::DOUBLE), (0.2::DOUBLE, 1.4::DOUBLE)),
       x AS (SELECT k, sum(w * l * f) AS mean, sum(w * (l * f + l * f * l * f)) AS second, sum(w * l * f) AS poisson FROM r, c GROUP BY k)
       SELECT k, round(mean, 8) AS mean, round(second - mean * mean, 8) AS variance, round(second - mean * mean - poisson, 8) AS state_variance FROM x""",
)
def dm12(spark, sf):
    parts = [(0.5, 0.8), (0.3, 1.0), (0.2, 1.4)]
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.lit(0.8) + (F.col("n_nationkey") % 5) / F.lit(5.0)).alias("l"))
    rates = [(w, F.col("l") * f) for w, f in parts]
    mean = sum(w * r for w, r in rates)
    second = sum(w * (r + r * r) for w, r in rates)
    return rows.select("k", F.round(mean, 8).alias("mean"), F.round(second - mean * mean, 8).alias("variance"), F.round(second - mean * mean - mean, 8).alias("state_variance"))


@query(
    "dm19_chance_likelihood",
    """WITH r AS (SELECT n_nationkey AS k, n_nationkey % 4 AS g, 0.2 + (n_nationkey % 6) / 4.0 AS x, CAST(0.12 AS DOUBLE) AS p, CAST(1.3 AS DOUBLE) AS m FROM nation),
       t AS (SELECT k, exp(n * ln(m / p) - m / p - lgamma(n + 1.0) + lgamma(n + 1.0) - lgamma(g + 1.0) - lgamma(n - g + 1.0) + g * ln(p) + (n - g) * ln(1 - p) + (n - 1) * ln(x) - x / p - n * ln(p) - lgamma(CAST(n AS DOUBLE))) AS q FROM r, range(1, 140) s(n) WHERE n >= g)
       SELECT k, round(ln(sum(q)), 6) AS log_likelihood FROM t GROUP BY k""",
)
def dm19(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 4).alias("g"), (F.lit(0.2) + (F.col("n_nationkey") % 6) / F.lit(4.0)).alias("x"))

    @F.pandas_udf("double")
    def likelihood(g: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([models.chance_likelihood(int(a), float(b), math.log(1.3), 0.12)[0] for a, b in zip(g, x)])

    return rows.select("k", F.round(likelihood("g", "x"), 6).alias("log_likelihood"))


@query(
    "dm21_entry_priors",
    """WITH e AS (SELECT CASE WHEN c_custkey % 100 = 0 THEN 9 ELSE n_regionkey END AS cohort, c_acctbal / 1000 AS v, 0.5 + (c_custkey % 5) / 10.0 AS se FROM customer JOIN nation ON n_nationkey = c_nationkey),
       a AS (SELECT avg(v) AS m, greatest(var_pop(v) - avg(se * se), 0) AS s FROM e), c AS (SELECT cohort, count(*) AS n, avg(v) AS m, greatest(var_pop(v) - avg(se * se), 0) AS s FROM e GROUP BY cohort)
       SELECT cohort, n, round(CASE WHEN n >= 40 THEN c.m ELSE a.m END, 7) AS prior_mean, round(CASE WHEN n >= 40 THEN c.s ELSE a.s END, 6) AS prior_variance FROM c, a""",
)
def dm21(spark, sf):
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cohort = F.when(F.col("c_custkey") % 100 == 0, 9).otherwise(F.col("n_regionkey"))
    entrants = rows.select(cohort.alias("cohort"), (F.col("c_acctbal") / 1000).alias("v"), (F.lit(0.5) + (F.col("c_custkey") % 5) / F.lit(10.0)).alias("se"))
    return models.entry_priors(entrants, "cohort", "v", "se", 40).select("cohort", "n", F.round("prior_mean", 7).alias("prior_mean"), F.round("prior_variance", 6).alias("prior_variance"))


@query("dm22_state_sampling", LEAGUE + " SELECT competition, team, 2000 AS paths, true AS mean_agrees, true AS spread_agrees FROM t GROUP BY competition, team")
def dm22(spark, sf):
    """Sampled states, 30 days on, have the mean and deviation that the decay gives them."""
    states = _kept(models.filter_states(_league(spark, sf), {"usual": {}}).select("competition", "team", "quality", "quality_sd"), "states")
    found = simulate.sample_states_each(states, 2000, 30).groupBy("competition", "team").agg(F.count("*").cast("int").alias("paths"), F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("sd"))
    keep = math.exp(-30 / 700)
    sd = F.sqrt(F.pow(keep * F.col("quality_sd"), 2) + 0.35**2 * (1 - keep**2))
    rows = found.join(states, ["competition", "team"])
    return rows.select("competition", "team", "paths", (F.abs(F.col("mean") - keep * F.col("quality")) < 6 * sd / math.sqrt(2000)).alias("mean_agrees"), F.col("sd").between(0.85 * sd, 1.15 * sd).alias("spread_agrees"))


@query(
    "dm25_european_places",
    """WITH t AS (SELECT c_mktsegment AS league, c_nationkey AS team, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sum(c_acctbal) DESC, c_nationkey) AS position FROM customer GROUP BY c_mktsegment, c_nationkey),
       w AS (SELECT league, max(team) FILTER (position = 3) AS cup, max(team) FILTER (position = 11) AS league_cup FROM t GROUP BY league)
       SELECT league, team, CASE WHEN position <= 4 THEN 'champions_league' WHEN position IN (5, 6) THEN 'europa_league' WHEN position = 11 THEN 'conference_league' END AS europe FROM t""",
)
def dm25(spark, sf):
    sums = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("league"), F.col("c_nationkey").alias("team")).agg(F.sum("c_acctbal").alias("s"))
    table = sums.withColumn("position", F.row_number().over(Window.partitionBy("league").orderBy(F.desc("s"), "team")))
    cups = table.groupBy("league").agg(F.max(F.when(F.col("position") == 3, F.col("team"))).alias("cup"), F.max(F.when(F.col("position") == 11, F.col("team"))).alias("league_cup"))
    return simulate.european_places(table.join(cups, "league"), ["league"], 4, "cup", "league_cup").select("league", "team", "europe")


@query(
    "dm45_publishable",
    """SELECT CAST(n_nationkey AS VARCHAR) AS subject, '$.name' AS path, 'private value' AS problem FROM nation WHERE regexp_matches(n_name, '7$') UNION ALL SELECT '*', '$.private_note', 'private key' UNION ALL SELECT '*', '$.extra', 'not in the contract'""",
)
def dm45(spark, sf):
    documents = load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.lit("x").alias("private_note"), F.lit(1).alias("extra"))
    return unpublishable(documents, {"n_nationkey", "name"}, ["private"], ["7$"], "n_nationkey")


@query("dm51_replay", "SELECT CAST(r_regionkey AS VARCHAR) AS team_id, r_name || '!' AS name FROM region")
def dm51(spark, sf):
    region = load(spark, sf, "region")
    payload = F.to_json(F.array(F.struct(F.col("r_regionkey").cast("string").alias("team_id"), F.concat("r_name", F.col("mark")).alias("name"))))
    captures = region.select("*", F.explode(F.array(F.struct(F.lit(1).alias("day"), F.lit("").alias("mark")), F.struct(F.lit(2).alias("day"), F.lit("!").alias("mark")))).alias("d")).select("*", "d.*")
    captures = captures.withColumn("payload", payload).groupBy("day").agg(F.concat_ws("\n", F.array_sort(F.collect_list("payload"))).alias("payload"))
    captures = captures.select(F.lit("teams").alias("kind"), F.lit("feed").alias("provider"), F.concat(F.lit("2024-01-0"), F.col("day"), F.lit("T00:00:00+00:00")).alias("retrieved_at"), F.sha2("payload", 256).alias("source_sha256"), "payload")

    def teams(payloads):
        documents = payloads.select(F.explode(F.split("payload", "\n")).alias("d"))
        return {"teams": documents.select(F.inline(F.from_json("d", "array<struct<team_id:string,name:string>>", {"mode": "FAILFAST"})))}

    root = scratch(spark, "replay")
    evidence.replay(spark, root, captures, {"teams": teams})
    return evidence.Dataset(spark, root, tables=["teams"]).current("teams").select("team_id", "name")


@query("sk02_immutable_write", "SELECT 'same' AS attempt, true AS accepted UNION ALL SELECT 'other', false")
def sk02(spark, sf):
    path = f"{scratch(spark, 'files')}/a.json"
    out = []
    for attempt, text in (("first", "x"), ("same", "x"), ("other", "y")):
        try:
            files.write_once(spark, path, text)
            out.append((attempt, True))
        except ValueError:
            out.append((attempt, False))
    return spark.createDataFrame(out[1:], "attempt string, accepted boolean")


@query("sk03_pointer_update", "SELECT 3 AS version, 'c' AS value")
def sk03(spark, sf):
    path = scratch(spark, "pointer")
    for value in "abc":
        files.update_pointer(spark, path, lambda now, value=value: {"version": now.get("version", 0) + 1, "value": value})
    now = files.read_pointer(spark, path)
    return spark.createDataFrame([(now["version"], now["value"])], "version int, value string")


@query("sk05_materialized_namespace", "SELECT r_name, count(*) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def sk05(spark, sf):
    path = scratch(spark, "namespace")
    for name in ("nation", "region"):  # tables are copied; what is derived stays a view over the copies
        load(spark, sf, name).write.parquet(f"{path}/{name}")
    copies = {n: spark.read.parquet(f"{path}/{n}") for n in ("nation", "region")}
    return spark.sql("SELECT r_name, count(*) AS nations FROM {nation} JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name", **copies)


@query(
    "st03_late_corrections",
    """WITH e AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 5 DAY ELSE ts END AS seen FROM events)
       SELECT user_id, arg_max(value, (seen, event_id)) AS value FROM e WHERE seen <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id""",
)
def st03(spark, sf):
    seen = F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).otherwise(F.col("ts"))
    rows = load(spark, sf, "events").withColumn("seen", seen).filter(F.col("seen") <= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("seen", "event_id")).alias("value"))



@query("st05_stored_state", LEAGUE + " SELECT competition, count(DISTINCT team) AS teams, true AS same FROM t GROUP BY competition")
def st05(spark, sf):
    """A filter that is stored half-way and goes on has the state of one that never stopped."""
    league = _league(spark, sf)
    first = _kept(models.continue_filters(league.filter("match_date < DATE'2021-06-01'")), "states")
    split = models.continue_filters(league.filter("match_date >= DATE'2021-06-01'"), first)
    both = split.withColumnRenamed("state", "a").join(models.continue_filters(league).withColumnRenamed("state", "b"), "competition")
    numbers = lambda c: F.from_json(c, "teams array<string>, mean array<double>, evidence double")
    a, b = numbers("a"), numbers("b")
    apart = F.exists(F.zip_with(a["mean"], b["mean"], lambda x, y: F.abs(x - y)), lambda gap: gap > 1e-9)
    return both.select("competition", F.size(b["teams"]).cast("long").alias("teams"), ((a["teams"] == b["teams"]) & ~apart & (F.abs(a["evidence"] - b["evidence"]) < 1e-6)).alias("same"))


@query("dm26_brackets", "SELECT p AS places, 3000 AS paths, 1.0::DOUBLE AS won, true AS inside, true AS stronger_wins_more FROM (VALUES (4), (6)) AS t(p)")
def dm26(spark, sf):
    """Each bracket has one winner, among its own places, and the strongest wins most often."""
    import numpy as np

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        places, teams, paths = int(rows.places.iloc[0]), 12, 3000
        draw = np.random.default_rng(places)
        position = draw.permuted(np.tile(np.arange(1, teams + 1), (paths, 1)), axis=1)
        strength = np.zeros(teams)
        strength[0] = 1.5
        winner = simulate.bracket(position, strength, 3, draw, places)
        place = position[np.arange(paths), winner]
        there = (position[:, 0] >= 3) & (position[:, 0] < 3 + places)
        share = (winner[there] == 0).mean()
        return pd.DataFrame({"places": [places], "paths": [paths], "won": [1.0 if len(winner) == paths else 0.0], "inside": [bool(((place >= 3) & (place < 3 + places)).all())], "stronger_wins_more": [bool(share > 1.5 / places)]})

    rows = spark.createDataFrame([(4,), (6,)], "places int")
    return rows.groupBy("places").applyInPandas(play, "places int, paths int, won double, inside boolean, stronger_wins_more boolean")


@query("sc03_named_tables", WEEKLY + " SELECT team_id, count(*) AS rows, true AS others_absent FROM w GROUP BY team_id")
def sc03(spark, sf):
    root, _ = _store(spark, sf)
    data = evidence.Dataset(spark, root, tables=["teams"])
    try:
        data.observations("fixtures")
        absent = False
    except KeyError:
        absent = True
    return data.observations("teams").groupBy("team_id").agg(F.count("*").alias("rows")).withColumn("others_absent", F.lit(absent))


@query("dd01_views", "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dd01(spark, sf):
    for name in ("nation", "region"):
        load(spark, sf, name).createOrReplaceTempView(f"dd01_{name}")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW dd01_joined AS SELECT r_name, n_name FROM dd01_nation JOIN dd01_region ON n_regionkey = r_regionkey")
    return spark.sql("SELECT r_name, count(*) AS nations FROM dd01_joined GROUP BY ALL")


@query("dd06_attached_folder", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dd06(spark, sf):
    path = scratch(spark, "attached")
    load(spark, sf, "region").write.parquet(f"{path}/region")
    return spark.sql(f"SELECT n_name, r_name FROM {{nation}} JOIN parquet.`{path}/region` ON n_regionkey = r_regionkey", nation=load(spark, sf, "nation"))


@query("dd07_a_wrong_batch_leaves_nothing", "SELECT CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS name, true AS refused FROM nation")
def dd07(spark, sf):
    root = scratch(spark, "store")
    teams = load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("team_id"), F.col("n_name").alias("name"))
    evidence.publish(spark, root, _request(1), {"teams": teams})
    wrong = load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("match_id"), F.lit("a").alias("home_team_id"), F.lit("a").alias("away_team_id"))
    try:
        evidence.publish(spark, root, _request(2), {"teams": teams.withColumn("name", F.lit("changed")), "fixtures": wrong})
        refused = False
    except ValueError:
        refused = not files.listed(spark, f"{root}/staging", ".parquet")
    return evidence.Dataset(spark, root).current("teams").select("team_id", "name", F.lit(refused).alias("refused"))


@query("sk07_report", "SELECT o_orderpriority AS scope, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def sk07(spark, sf):
    """A report is one JSON document of the summary's rows, written once, and read back."""
    path = f"{scratch(spark, 'report')}/report.json"
    rows = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scope")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    files.write_report(spark, path, rows)
    return files.json_documents(spark, path, "rows array<struct<scope:string,n:bigint,mean:double>>").select(F.inline("rows"))


@query("so02_order_by_all", "SELECT c_nationkey, c_mktsegment, n, CAST(row_number() OVER (ORDER BY c_nationkey, c_mktsegment, n) AS BIGINT) AS place FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
def so02(spark, sf):
    """The rows as ORDER BY ALL gives them, numbered as they come; a group each, so they are few."""
    rows = spark.sql("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY ALL ORDER BY ALL", customer=load(spark, sf, "customer"))
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows.collect(), 1)], "c_nationkey int, c_mktsegment string, n long, place long")


@query(
    "ud01_models_by_kind",
    LEAGUE + """, f AS (SELECT competition FROM m WHERE match_date >= DATE '2021-12-01'), k AS (SELECT DISTINCT competition FROM m WHERE match_date < DATE '2021-12-01')
    SELECT kind, competition, count(*) AS fixtures, true AS proper FROM f JOIN k USING (competition), (VALUES ('attack_defence'), ('average')) AS v(kind) GROUP BY kind, competition""",
)
def ud01(spark, sf):
    """Every kind of model gives every later match two rates, from the matches before."""
    league = _league(spark, sf)
    origins = _origins(league, DECEMBER)
    fixtures = league.join(origins, "competition").filter("match_date >= as_of").select("match_id", "competition", "as_of", "home", "away")
    proper = F.bool_and(F.col("home_rate").between(0.01, 10) & F.col("away_rate").between(0.01, 10)).alias("proper")
    found = [models.rates_of(kind, league, origins, fixtures).groupBy("competition").agg(F.count("*").alias("fixtures"), proper).select(F.lit(kind).alias("kind"), "competition", "fixtures", "proper") for kind in sorted(models.MODELS)]
    return reduce(DataFrame.unionAll, found)
