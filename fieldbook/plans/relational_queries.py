"""Queries of filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators.relops import digest, global_row_number, grain_violations, in_scope, lineage, paired, pivot_stages
from fieldbook.plans.registry import query
from fieldbook.session import load, scratch

# --- projections, filters, predicates


@query("pr01_projection", "SELECT o_orderkey, 'home' AS venue, CAST(NULL AS VARCHAR) AS note, o_totalprice AS price FROM orders")
def pr01(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.lit("home").alias("venue"), F.lit(None).cast("string").alias("note"), F.col("o_totalprice").alias("price"))


@query(
    "pr02_outcome_label",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_totalprice > 60000 THEN 'W' WHEN o_totalprice > 30000 THEN 'D' ELSE 'L' END AS outcome FROM orders""",
)
def pr02(spark, sf):
    price = F.col("o_totalprice")
    outcome = F.when(price > 60000, "W").when(price > 30000, "D").otherwise("L")
    return load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", outcome).alias("outcome"))


@query(
    "pr06_prefix_and_lists",
    """SELECT p_partkey, p_type, p_brand FROM part WHERE p_name LIKE 'p%' AND p_size IN (1, 5, 9, 15, 23) AND p_type IS NOT NULL AND coalesce(p_brand, '') <> 'Brand#11'""",
)
def pr06(spark, sf):
    part = load(spark, sf, "part")
    kept = part.filter(F.col("p_name").like("p%") & F.col("p_size").isin(1, 5, 9, 15, 23) & F.col("p_type").isNotNull() & (F.coalesce("p_brand", F.lit("")) != "Brand#11"))
    return kept.select("p_partkey", "p_type", "p_brand")


@query(
    "pr07_null_safe_equality",
    """WITH e AS (SELECT event_id, CASE WHEN value > 50 THEN event_type END AS kind FROM events), k AS (SELECT DISTINCT kind FROM e)
       SELECT k.kind, count(*) AS n FROM e JOIN k ON e.kind IS NOT DISTINCT FROM k.kind GROUP BY k.kind""",
)
def pr07(spark, sf):
    kinds = load(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("kind"))
    known = kinds.select(F.col("kind").alias("k")).distinct()
    return kinds.join(known, F.col("kind").eqNullSafe(F.col("k"))).groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "pr08_validity_predicates",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE least(l_quantity, l_extendedprice) < 0 OR greatest(l_discount, l_tax) > 0.09 OR NOT isfinite(l_extendedprice) OR l_quantity <> floor(l_quantity)""",
)
def pr08(spark, sf):
    rows = load(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    finite = ~F.isnan(price) & (F.abs(price) < float("inf"))
    bad = (F.least("l_quantity", "l_extendedprice") < 0) | (F.greatest("l_discount", "l_tax") > 0.09) | ~finite | (F.col("l_quantity") != F.floor("l_quantity"))
    return rows.filter(bad).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "pr10_probability_sums",
    """WITH s AS (SELECT p_brand, p_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM part GROUP BY p_brand, p_type)
       SELECT p_brand, count(*) AS cells, abs(sum(p) - 1) > 2e-6 AS violated FROM s GROUP BY p_brand""",
)
def pr10(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")))
    return shares.groupBy("p_brand").agg(F.count("*").alias("cells"), (F.abs(F.sum("p") - 1) > 2e-6).alias("violated"))


@query(
    "pr11_horizon",
    """SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 6 DAY AND event_type IN ('click', 'signup')""",
)
def pr11(spark, sf):
    cutoff = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    near = (F.col("ts") > cutoff) & (F.col("ts") <= cutoff + F.expr("INTERVAL 6 DAYS"))
    return load(spark, sf, "events").filter(near & F.col("event_type").isin("click", "signup")).select("event_id", "event_type")


@query(
    "pr12_public_horizon",
    """WITH m AS (SELECT event_id, ts, user_id AS home, (event_id * 7 + 3) % 150 AS away FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00'),
       s AS (SELECT event_id, ts, home AS team FROM m UNION ALL SELECT event_id, ts, away FROM m),
       f AS (SELECT event_id, min(r) AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY team ORDER BY ts, event_id) AS r FROM s) GROUP BY event_id)
       SELECT event_id, place = 1 AS next_match FROM m JOIN f USING (event_id) WHERE ts <= TIMESTAMP '2024-01-12 00:00:00' OR place = 1""",
)
def pr12(spark, sf):
    matches = load(spark, sf, "events").filter(F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"))
    sides = matches.select("event_id", "ts", F.explode(F.array("user_id", (F.col("event_id") * 7 + 3) % 150)).alias("team"))
    place = F.row_number().over(Window.partitionBy("team").orderBy("ts", "event_id"))
    first = sides.withColumn("r", place).groupBy("event_id").agg(F.first("ts").alias("ts"), F.min("r").alias("place"))
    return first.filter((F.col("ts") <= F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'")) | (F.col("place") == 1)).select("event_id", (F.col("place") == 1).alias("next_match"))


@query(
    "pr13_status_mapping",
    """SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN 'unscheduled' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'P' THEN 'in_progress'
         WHEN o_orderdate < TIMESTAMP '1995-01-01 00:00:00' THEN 'awaiting_result' ELSE 'scheduled' END AS status FROM orders""",
)
def pr13(spark, sf):
    status = (
        F.when(F.col("o_orderdate").isNull(), "unscheduled")
        .when(F.col("o_orderstatus") == "F", "finished")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .when(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"), "awaiting_result")
        .otherwise("scheduled")
    )
    return load(spark, sf, "orders").select("o_orderkey", status.alias("status"))


@query("pr14_token_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') AND contains(lower(url), 'en')")
def pr14(spark, sf):
    pages = load(spark, sf, "pages")
    for token in "example en".split():
        pages = pages.filter(F.contains(F.lower("url"), F.lit(token)))
    return pages.select("page_id", "url")


@query("pr15_bound_parameters", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0 AND c_mktsegment = 'BUILDING'")
def pr15(spark, sf):
    sql = "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > :least AND c_mktsegment = :segment"
    return spark.sql(sql, args={"least": 5000.0, "segment": "BUILDING"}, customer=load(spark, sf, "customer"))


@query(
    "pr16_version_scope",
    """SELECT e.event_type, count(*) AS n FROM events e JOIN (SELECT event_type, max(user_id) AS v FROM events GROUP BY event_type) c
       ON c.event_type = e.event_type AND c.v = e.user_id GROUP BY e.event_type""",
)
def pr16(spark, sf):
    events = load(spark, sf, "events")
    current = events.groupBy("event_type").agg(F.max("user_id").alias("user_id"))
    return events.join(current, ["event_type", "user_id"], "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


# --- joins


@query(
    "pr16_version_scopes",
    """WITH c AS (SELECT arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders) SELECT 'all' AS scope, count(*) AS n FROM orders UNION ALL SELECT 'none', 0 UNION ALL SELECT 'current', count(*) FROM orders WHERE o_orderpriority = (SELECT v FROM c)
       UNION ALL SELECT 'named', count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def pr16b(spark, sf):
    """Priorities stand in for model versions; the current one is that of the last order."""
    orders = load(spark, sf, "orders")
    current = orders.agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("o_orderpriority"))
    scopes = {"all": "all", "none": "none", "current": "current", "named": ["1-URGENT", "5-LOW"]}
    counts = [in_scope(orders, "o_orderpriority", scope, current).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n") for name, scope in scopes.items()]
    return reduce(DataFrame.unionAll, counts)


@query(
    "jo01_inner_multi_key",
    """SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
def jo01(spark, sf):
    # Totals by customer first: the orders meet no join, only their partial sums do.
    spent = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    by_nation = spent.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("orders"), F.sum("total").alias("total"))
    nations = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "orders", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("jo02_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jo02(spark, sf):
    counts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    return load(spark, sf, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "jo04_stage_self_join",
    """SELECT a.user_id, a.n AS original, b.n AS adjusted FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) a
       JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) b ON a.user_id = b.user_id WHERE a.n <> b.n""",
)
def jo04(spark, sf):
    # One pass: the two stages of a key are two filtered counts.
    events = load(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    both = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("original"), F.count_if(F.col("event_type") == "click").alias("adjusted"))
    return both.filter("original > 0 and adjusted > 0 and original <> adjusted")


@query(
    "jo05_dimension_twice",
    """SELECT o_orderkey, h.n_name AS home, a.n_name AS away FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = (c_nationkey + 7) % 25""",
)
def jo05(spark, sf):
    nation = load(spark, sf, "nation")
    home, away = (nation.select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(side)) for side in ("home", "away"))
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(home, F.col("home_key") == F.col("c_nationkey")).join(away, F.col("away_key") == (F.col("c_nationkey") + 7) % 25)
    return rows.select("o_orderkey", "home", "away")


@query(
    "jo06_exists_or_exists",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 90000)
       OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
)
def jo06(spark, sf):
    # Both conditions look at one table: one semi join with their disjunction.
    wanted = load(spark, sf, "orders").filter((F.col("o_totalprice") > 90000) | (F.col("o_orderstatus") == "P")).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey")


@query("jo07_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jo07(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "jo08_two_sided_completeness",
    """WITH x AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL)
       SELECT h.l_orderkey, h.q AS home_xg, a.q AS away_xg FROM x h JOIN x a ON a.l_orderkey = h.l_orderkey AND h.l_linenumber = 1 AND a.l_linenumber = 2""",
)
def jo08(spark, sf):
    sides = load(spark, sf, "lineitem").filter(F.col("l_linenumber").isin(1, 2)).groupBy("l_orderkey")
    both = sides.agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("home_xg"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_quantity"))).alias("away_xg"))
    return both.filter("home_xg is not null and away_xg is not null")


@query(
    "jo09_matched_predictions",
    """SELECT d.doc_id, l.quality, d.n FROM labels l JOIN (SELECT doc_id, max(n_chars) AS n FROM documents GROUP BY doc_id HAVING count(*) = 1) d ON d.doc_id = l.doc_id
       WHERE l.quality IS NOT NULL""",
)
def jo09(spark, sf):
    single = load(spark, sf, "documents").groupBy("doc_id").agg(F.max("n_chars").alias("n"), F.count("*").alias("copies")).filter("copies = 1")
    return load(spark, sf, "labels").filter("quality is not null").join(single, "doc_id").select("doc_id", "quality", "n")


@query(
    "jo09_paired_rows",
    "SELECT o_orderkey AS id, o_custkey % 2 AS outcome, o_totalprice AS stated, round(sum(l_extendedprice), 4) AS summed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
)
def jo09b(spark, sf):
    """Two accounts of an order, which must be one each and tell of the same outcome."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("outcome"), F.col("o_totalprice").alias("stated"))
    sums = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 4).alias("summed"))
    other = sums.join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("outcome")), "id")
    return paired(orders, other, ["id"], ["outcome"]).select("id", "outcome", "stated", "summed")


@query(
    "jo13_unique_name_resolution",
    r"""WITH n AS (SELECT c_custkey, c_nationkey, regexp_replace(lower(c_mktsegment || '-' || (c_custkey % 400)), '[^a-z0-9]', '', 'g') AS k FROM customer),
        u AS (SELECT k, c_nationkey, min(c_custkey) AS c_custkey FROM n GROUP BY k, c_nationkey HAVING count(DISTINCT c_custkey) = 1)
        SELECT n_name, count(*) AS linked FROM u JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def jo13(spark, sf):
    name = F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 400).cast("string"))
    token = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    named = load(spark, sf, "customer").groupBy(token.alias("k"), "c_nationkey").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    linked = named.filter("low = high").groupBy("c_nationkey").agg(F.count("*").alias("linked"))
    return linked.join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "linked")


@query(
    "jo14_duplicate_identities",
    """SELECT a.s_suppkey AS first_id, b.s_suppkey AS second_id, a.s_nationkey FROM supplier a JOIN supplier b
       ON a.s_nationkey = b.s_nationkey AND right(a.s_name, 1) = right(b.s_name, 1) AND a.s_suppkey < b.s_suppkey""",
)
def jo14(spark, sf):
    people = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.expr("right(s_name, 1)").alias("name"))
    other = people.select(F.col("s_suppkey").alias("second_id"), "s_nationkey", "name")
    pairs = people.withColumnRenamed("s_suppkey", "first_id").join(other, ["s_nationkey", "name"]).filter("first_id < second_id")
    return pairs.select("first_id", "second_id", "s_nationkey")


@query(
    "jo15_entry_cohorts",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS season, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS tier FROM orders GROUP BY ALL)
       SELECT n.o_custkey, CAST(n.season AS INTEGER) AS season, CASE WHEN p.tier IS NULL THEN 'from_outside' WHEN p.tier = n.tier THEN 'stayed' WHEN p.tier > n.tier THEN 'fell' ELSE 'rose' END AS cohort
       FROM y n LEFT JOIN y p ON p.o_custkey = n.o_custkey AND p.season = n.season - 1""",
)
def jo15(spark, sf):
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    seasons = load(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.max(tier).alias("tier"))
    # The season before is the row before it, if it is that of the year before: no self-join.
    order = Window.partitionBy("o_custkey").orderBy("season")
    before = F.when(F.lag("season").over(order) == F.col("season") - 1, F.lag("tier").over(order))
    rows = seasons.withColumn("before", before)
    cohort = F.when(F.col("before").isNull(), "from_outside").when(F.col("before") == F.col("tier"), "stayed").when(F.col("before") > F.col("tier"), "fell").otherwise("rose")
    return rows.select("o_custkey", "season", cohort.alias("cohort"))


# --- aggregates


@query("ag01_basic", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, min(ts) AS first_ts FROM events GROUP BY 1, 2")
def ag01(spark, sf):
    events = load(spark, sf, "events")
    return events.groupBy("event_type", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.min("ts").alias("first_ts"))


@query("ag02_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def ag02(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query(
    "ag03_filtered",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) FILTER (WHERE event_type = 'purchase') AS best, round(sum(value) FILTER (WHERE event_type = 'none'), 2) AS nothing FROM events GROUP BY user_id""",
)
def ag03(spark, sf):
    kind = F.col("event_type")
    return load(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("errors"), F.max(F.when(kind == "purchase", F.col("value"))).alias("best"), F.round(F.sum(F.when(kind == "none", F.col("value"))), 2).alias("nothing"))


@query(
    "ag04_pivot",
    "SELECT user_id, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
)
def ag04(spark, sf):
    return pivot_stages(load(spark, sf, "events"), ["user_id"], "event_type", "value", ["view", "click", "purchase"])


@query("ag05_bool", "SELECT user_id, bool_and(value > 1) AS all_large, bool_or(event_type = 'purchase' AND value > 190) AS any_big FROM events GROUP BY user_id")
def ag05(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.bool_and(F.col("value") > 1).alias("all_large"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 190)).alias("any_big"))


@query("ag07_ordered_list", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS keys, len(list(o_orderkey)) AS n FROM orders GROUP BY o_custkey")
def ag07(spark, sf):
    rows = load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("rows"))
    return rows.select("o_custkey", F.col("rows.o_orderkey").alias("keys"), F.size("rows").cast("long").alias("n"))


@query("ag08_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550 AND abs(avg(l_discount) - 0.05) > 0.0001")
def ag08(spark, sf):
    # The SQL's comparison of doubles, but the sum is of decimals of 18 places, so that a mean on the
    # bound does not hang on the order of addition. NaN, infinite and huge values keep the plain mean.
    exact = F.col("l_discount").try_cast("decimal(28,18)")
    mean = F.when(F.count(exact) == F.count("l_discount"), F.try_sum(exact).cast("double") / F.nullif(F.count("l_discount"), F.lit(0)))
    grouped = load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.coalesce(mean, F.avg("l_discount")).alias("mean"))
    return grouped.filter((F.col("n") > 550) & (F.abs(F.col("mean") - 0.05) > 0.0001)).select("l_suppkey", "n")


@query("ag09_distinct_rows", "SELECT count(*) AS rows FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)")
def ag09(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct().agg(F.count("*").alias("rows"))


@query(
    "ag10_swing",
    """SELECT event_type, max(swing) AS leverage FROM (SELECT event_type, user_id, max(value) - min(value) AS swing FROM events GROUP BY event_type, user_id) GROUP BY event_type""",
)
def ag10(spark, sf):
    swing = load(spark, sf, "events").groupBy("event_type", "user_id").agg((F.max("value") - F.min("value")).alias("swing"))
    return swing.groupBy("event_type").agg(F.max("swing").alias("leverage"))


@query(
    "ag11_population_moments",
    """SELECT l_returnflag, round(avg(l_quantity), 8) AS mean, round(var_pop(l_quantity), 6) AS variance, round(covar_pop(l_quantity, l_discount), 7) AS covariance,
         round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 8) AS none, count(*) - count(l_tax) AS missing FROM lineitem GROUP BY l_returnflag""",
)
def ag11(spark, sf):
    none = F.avg(F.when(F.col("l_discount") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 8).alias("mean"),
        F.round(F.var_pop("l_quantity"), 6).alias("variance"),
        F.round(F.covar_pop("l_quantity", "l_discount"), 7).alias("covariance"),
        F.round(none, 8).alias("none"),
        (F.count("*") - F.count("l_tax")).alias("missing"),
    )


@query("ag14_empirical_distribution", "SELECT p_brand, p_size, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 9) AS share FROM part GROUP BY p_brand, p_size")
def ag14(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")), 9))


@query(
    "ag15_quantiles",
    """WITH c AS (SELECT p_brand, p_size, sum(count(*)) OVER (PARTITION BY p_brand ORDER BY p_size) / sum(count(*)) OVER (PARTITION BY p_brand) AS cdf FROM part GROUP BY p_brand, p_size),
       d AS (SELECT p_brand, min(p_size) FILTER (WHERE cdf >= 0.05) AS low, min(p_size) FILTER (WHERE cdf >= 0.95) AS high FROM c GROUP BY p_brand)
       SELECT p.p_brand, round(quantile_cont(CAST(p_size AS DOUBLE), 0.25), 9) AS linear, CAST(quantile_disc(p_size, 0.5) AS DOUBLE) AS inverted, any_value(low) AS low, any_value(high) AS high
       FROM part p JOIN d USING (p_brand) GROUP BY p.p_brand""",
)
def ag15(spark, sf):
    part = load(spark, sf, "part")
    counts = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    running = Window.partitionBy("p_brand").orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)
    cdf = counts.withColumn("cdf", F.sum("n").over(running) / F.sum("n").over(Window.partitionBy("p_brand")))
    ends = cdf.groupBy("p_brand").agg(F.min(F.when(F.col("cdf") >= 0.05, F.col("p_size"))).alias("low"), F.min(F.when(F.col("cdf") >= 0.95, F.col("p_size"))).alias("high"))
    plain = part.groupBy("p_brand").agg(F.round(F.expr("percentile(double(p_size), 0.25)"), 9).alias("linear"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size)").alias("inverted"))
    return plain.join(ends, "p_brand")


@query(
    "ag16_mixture_moments",
    """WITH g AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS w, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY ALL)
       SELECT f, round(sum(w * m) / sum(w), 7) AS mean, round(sum(w * (v + m * m)) / sum(w) - power(sum(w * m) / sum(w), 2), 6) AS variance FROM g GROUP BY f""",
)
def ag16(spark, sf):
    parts = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("w"), F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v"))
    mean = F.sum(F.col("w") * F.col("m")) / F.sum("w")
    second = F.sum(F.col("w") * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("w")
    return parts.groupBy(F.col("l_returnflag").alias("f")).agg(F.round(mean, 7).alias("mean"), F.round(second - mean * mean, 6).alias("variance"))


@query(
    "ag17_grouping_sets",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 7) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())""",
)
def ag17(spark, sf):
    sql = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 7) AS mean FROM {rows} GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())"
    return spark.sql(sql, rows=load(spark, sf, "lineitem"))


#: The sums of ``relops.digest`` over hashes h, and the line that is hashed.
DIGEST_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS VARCHAR) AS {name}" for at, name in ((1, "sum_a"), (16, "sum_b")))


def digest_line(columns):
    return "concat_ws('|', " + ", ".join(f"coalesce(len(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns) + ")"


@query("ag18_latest_record_state", "SELECT event_type, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY event_type")
def ag18(spark, sf):
    last = load(spark, sf, "events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return last.select("event_type", F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_event"))


@query(
    "ag19_order_free_digest",
    f"""SELECT event_type, count(*) AS n, {DIGEST_SUMS} FROM (SELECT event_type, sha256({digest_line(["event_id", "user_id", "props"])}) AS h FROM events) GROUP BY event_type""",
)
def ag19(spark, sf):
    events = load(spark, sf, "events")
    return events.groupBy("event_type").agg(*digest(events, ["event_id", "user_id", "props"]))


# --- windows


@query("wn04_nth_prefix", "SELECT o_custkey, o_orderkey, round(s, 2) AS running FROM (SELECT *, sum(o_totalprice) OVER w AS s, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE r = 5")
def wn04(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(running, 2).alias("running"), F.row_number().over(order).alias("r")).filter("r = 5").drop("r")


@query("wn06_cumulative_distribution", "SELECT p_brand, p_size, round(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) / sum(n) OVER (PARTITION BY p_brand), 9) AS cdf FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def wn06(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    running = Window.partitionBy("p_brand").orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("p_brand", "p_size", F.round(F.sum("n").over(running) / F.sum("n").over(Window.partitionBy("p_brand")), 9).alias("cdf"))


@query("wn07_day_groups", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def wn07(spark, sf):
    return load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "wn09_last_per_london_day",
    """WITH e AS (SELECT event_id, user_id, CAST((((ts + INTERVAL 6 MONTH) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS DATE) AS day, ts FROM events)
       SELECT user_id, day, max(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id, day ORDER BY ts DESC) AS r FROM e) WHERE r = 1 GROUP BY user_id, day""",
)
def wn09(spark, sf):
    london = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), F.col("ts") + F.expr("INTERVAL 6 MONTHS")))
    last = load(spark, sf, "events").groupBy("user_id", london.alias("day")).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", "day", F.col("last.event_id").alias("event_id"))


@query("wn10_ordinals", "SELECT doc_id, pos - 1 AS ordinal, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(source || '-' || lang, '-') AS w FROM documents))")
def wn10(spark, sf):
    words = F.split(F.concat_ws("-", "source", "lang"), "-")
    return load(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("ordinal", "word")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("wn11_block_index", "SELECT o_orderkey, CAST(floor(datediff('day', make_date(y, 7, 1), d) / 28.0) AS BIGINT) AS block FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y FROM orders)")
def wn11(spark, sf):
    season = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)
    days = F.datediff(F.to_date("o_orderdate"), F.make_date(season, F.lit(7), F.lit(1)))
    return load(spark, sf, "orders").select("o_orderkey", F.floor(days / F.lit(28.0)).alias("block"))


# --- sorts, limits, top-k


@query("so01_nulls_last_order", "SELECT event_id, row_number() OVER (ORDER BY v ASC NULLS LAST, event_id DESC) AS place FROM (SELECT event_id, CASE WHEN value > 150 THEN value END AS v FROM events)")
def so01(spark, sf):
    rows = load(spark, sf, "events").select("event_id", F.when(F.col("value") > 150, F.col("value")).alias("v"))
    return global_row_number(rows, [F.col("v").asc_nulls_last(), F.desc("event_id")], "place", scratch(spark, "ranked")).select("event_id", "place")


@query("so03_limit_and_offset", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 8")
def so03(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(8).limit(20)


@query("so04_top_one", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def so04(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


@query("so05_top_three_cells", "SELECT p_brand, p_size, n, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size)) WHERE r <= 3")
def so05(spark, sf):
    counts = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_size"))).filter("place <= 3")


@query("so07_lexicographic_table", "SELECT c_nationkey, CAST(row_number() OVER (ORDER BY count(*) DESC, round(sum(c_acctbal), 2) DESC, c_nationkey) AS INTEGER) AS place FROM customer GROUP BY c_nationkey")
def so07(spark, sf):
    table = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return table.select("c_nationkey", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("total"), "c_nationkey")).alias("place"))


@query("so08_missing_dates_last", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d ASC NULLS LAST, event_id) AS INTEGER) AS place FROM (SELECT event_id, user_id, CASE WHEN value > 20 THEN CAST(ts AS DATE) END AS d FROM events)")
def so08(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id", F.when(F.col("value") > 20, F.to_date("ts")).alias("d"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("d").asc_nulls_last(), "event_id")).alias("place"))


# --- set operations


@query("se01_union_all", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def se01(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return customers.unionAll(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))


@query("se02_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_name AS name, s_suppkey AS id FROM supplier")
def se02(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("se03_union_distinct_in", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def se03(spark, sf):
    customers = load(spark, sf, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    suppliers = load(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return load(spark, sf, "nation").join(customers.union(suppliers).distinct(), "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("se04_distinct_union", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 < 7 UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 > 3")
def se04(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.filter("o_orderkey % 10 < 7").union(orders.filter("o_orderkey % 10 > 3")).distinct()


@query("se05_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def se05(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("se06_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def se06(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query(
    "se07_recursive_lineage",
    """WITH RECURSIVE r AS (SELECT event_id, event_id AS anc, 0 AS depth FROM events WHERE event_id > 0 UNION ALL SELECT event_id, CAST(floor(anc / 2) AS BIGINT), depth + 1 FROM r WHERE anc > 1)
       SELECT event_id, min(anc) AS root, CAST(max(depth) AS BIGINT) AS depth FROM r GROUP BY event_id""",
)
def se07(spark, sf):
    edges = load(spark, sf, "events").filter("event_id > 0").select("event_id", F.when(F.col("event_id") > 1, F.floor(F.col("event_id") / 2)).alias("parent"))
    return lineage(edges, "event_id", "parent").withColumnRenamed("node", "event_id")


@query("pr09_unique_grain", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1")
def pr09b(spark, sf):
    return grain_violations(load(spark, sf, "orders"), ["o_orderkey"])
