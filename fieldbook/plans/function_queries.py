"""Queries of the scalar, array, map, JSON and hash functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldbook.functions import columns as C
from fieldbook.plans.registry import query
from fieldbook.session import load


@query("fn01_null_handling", "SELECT event_id, coalesce(CASE WHEN value > 150 THEN value END, -1.0) AS v, TRY_CAST(event_type AS INTEGER) AS bad, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn01(spark, sf):
    return load(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.when(F.col("value") > 150, F.col("value")), F.lit(-1.0)).alias("v"),
        F.col("event_type").try_cast("int").alias("bad"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


@query(
    "fn02_math",
    """SELECT p_partkey, abs(p_size - 25) AS a, greatest(p_size, 10) AS g, least(p_size, 10) AS l, round(ln(p_retailprice), 9) AS n, round(exp(p_size / 50.0), 9) AS e,
         round(sqrt(p_retailprice), 9) AS s, round(pow(2.0, p_size / 10.0), 7) AS t, isfinite(p_retailprice) AS f FROM part""",
)
def fn02(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return load(spark, sf, "part").select(
        "p_partkey",
        F.abs(size - 25).alias("a"),
        F.greatest(size, F.lit(10)).alias("g"),
        F.least(size, F.lit(10)).alias("l"),
        F.round(F.log(price), 9).alias("n"),
        F.round(F.exp(size / 50.0), 9).alias("e"),
        F.round(F.sqrt(price), 9).alias("s"),
        F.round(F.pow(F.lit(2.0), size / 10.0), 7).alias("t"),
        (~F.isnan(price) & (F.abs(price) < float("inf"))).alias("f"),
    )


@query(
    "fn03_strings",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, string_split(url, '/')[1] AS scheme, regexp_extract(url, '([0-9]+)', 1) AS number,
          starts_with(url, 'https') AS secure, upper(right(url, 3)) AS tail FROM pages""",
)
def fn03(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.split("url", "/")[0].alias("scheme"),
        F.regexp_extract("url", "([0-9]+)", 1).alias("number"),
        F.startswith("url", F.lit("https")).alias("secure"),
        F.upper(F.expr("right(url, 3)")).alias("tail"),
    )


@query(
    "fn03_name_tokens",
    f"""SELECT doc_id, regexp_extract_all(translate(lower(text), '{C.ACCENTED}', '{C.PLAIN}'), '([a-z]+)') AS tokens FROM documents""",
)
def fn03b(spark, sf):
    return load(spark, sf, "documents").select("doc_id", C.name_tokens(F.col("text")).alias("tokens"))


@query(
    "fn04_seasons",
    """SELECT o_orderkey, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, strftime(o_orderdate, '%Y-%m-%dT%H%M%SZ') AS stamp
       FROM (SELECT o_orderkey, o_orderdate, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y FROM orders)""",
)
def fn04(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", C.season_of(F.col("o_orderdate")).alias("season"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HHmmss'Z'").alias("stamp"))


@query(
    "fn04_london_days",
    """SELECT event_id, CAST(((t AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS DATE) AS day,
         (CAST(CAST(((t AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS DATE) AS TIMESTAMP) AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' AS midnight
       FROM (SELECT event_id, ts + INTERVAL 6 MONTH AS t FROM events)""",
)
def fn04b(spark, sf):
    day = C.local_day(F.col("ts") + F.expr("INTERVAL 6 MONTHS"))
    return load(spark, sf, "events").select("event_id", day.alias("day")).withColumn("midnight", C.local_midnight(F.col("day")))


@query(
    "fn04_day_formats",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS long_day, CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) >= 1970""",
)
def fn04c(spark, sf):
    orders = load(spark, sf, "orders").filter(F.year("o_orderdate") >= 1970)
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    day = C.parsed_day(text)
    return orders.select("o_orderkey", F.to_date("o_orderdate").alias("long_day"), day.alias("day"))


@query(
    "fn04_weekly_origins",
    """SELECT CAST(d AS DATE) AS origin, count(event_id) AS before_origin FROM (SELECT unnest(range(DATE '2024-01-03', DATE '2024-02-07', INTERVAL 7 DAY)) AS d) LEFT JOIN events ON ts < d GROUP BY 1""",
)
def fn04d(spark, sf):
    origins = F.expr("sequence(DATE'2024-01-03', DATE'2024-01-31', INTERVAL 7 DAYS)")
    # Each event falls to the first origin after it; a running sum over the origins gives the counts.
    after = F.array_min(F.filter(origins, lambda d: F.col("ts") < d.cast("timestamp_ntz")))
    counts = load(spark, sf, "events").groupBy(after.alias("origin")).agg(F.count("*").alias("n"))
    rows = spark.range(1).select(F.explode(origins).alias("origin")).join(counts, "origin", "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("origin").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("origin", upto.alias("before_origin"))


@query(
    "fn05_arrays",
    """WITH g AS (SELECT c_nationkey AS k, list(c_acctbal ORDER BY c_custkey) AS l FROM customer GROUP BY c_nationkey)
       SELECT k, len(l) AS n, l[1] AS first, l[1:3] AS head, len(list_filter(l, lambda x: x > 0)) AS positive, list_transform(l[1:2], lambda x: x > 0) AS signs FROM g""",
)
def fn05(spark, sf):
    grouped = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("rows"))
    balances = F.col("rows.c_acctbal")
    return grouped.select(
        "k",
        F.size("rows").cast("long").alias("n"),
        F.get(balances, 0).alias("first"),
        F.slice(balances, 1, 3).alias("head"),
        F.size(F.filter(balances, lambda x: x > 0)).cast("long").alias("positive"),
        F.transform(F.slice(balances, 1, 2), lambda x: x > 0).alias("signs"),
    )


@query(
    "fn05_grid_flatten",
    """SELECT n_nationkey, i AS home_goals, j AS away_goals, round(n_nationkey / 10.0 + i * 3 + j, 6) AS cell FROM nation, range(0, 4) a(i), range(0, 3) b(j)""",
)
def fn05b(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.col("n_nationkey") / 10.0 + i * 3 + j))
    flat = load(spark, sf, "nation").select("n_nationkey", F.posexplode(F.flatten(grid)).alias("at", "cell"))
    return flat.select("n_nationkey", F.floor(F.col("at") / 3).alias("home_goals"), (F.col("at") % 3).cast("long").alias("away_goals"), F.round("cell", 6).alias("cell"))


@query("fn06_map_to_rows", "SELECT event_id, CAST('k' AS VARCHAR) AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def fn06(spark, sf):
    return load(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value"))


@query("fn07_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def fn07(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("fn08_content_hash", "SELECT doc_id, sha256(text) AS digest, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source)) AS identity FROM documents")
def fn08(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source"), 256).alias("identity"))


@query("fn09_rounding", "SELECT p_partkey, round(p_retailprice / 7, 6) AS six, CAST(round(CAST(p_size / 51.0 AS DECIMAL(20,10)) * 100, 0) AS INTEGER) AS percent, p_size / 51.0 < 5e-2 AS dropped FROM part")
def fn09(spark, sf):
    share = F.col("p_size") / F.lit(51.0)
    return load(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 6).alias("six"), C.percent_points(share).alias("percent"), (share < 5e-2).alias("dropped"))


@query("fn10_identifiers", "SELECT o_orderkey, concat_ws(':', o_orderstatus, CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0'), CAST(o_custkey AS VARCHAR)) AS id, true AS valid FROM (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y FROM orders)")
def fn10(spark, sf):
    season = C.season_of(F.col("o_orderdate"))
    return load(spark, sf, "orders").select("o_orderkey", C.fixture_id(F.col("o_orderstatus"), season, F.col("o_custkey").cast("string")).alias("id"), C.valid_season(season).alias("valid"))


@query("fn11_unpivot", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME event VALUE probability")
def fn11(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "event", "probability")


@query(
    "fn12_checked_decimals",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 100 AS VARCHAR) || '.25' END AS s FROM events)
       SELECT event_id, CASE WHEN v BETWEEN 0 AND 60 THEN v END AS v, CASE WHEN s IS NULL THEN NULL WHEN v IS NULL THEN 'not a decimal' WHEN NOT v BETWEEN 0 AND 60 THEN 'out of range' END AS issue
       FROM (SELECT *, TRY_CAST(s AS DECIMAL(10,4)) AS v FROM t)""",
)
def fn12(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, None).otherwise(F.concat((F.col("event_id") % 100).cast("string"), F.lit(".25")))
    rows = load(spark, sf, "events").select("event_id", text.alias("s"))
    value, issue = C.checked_decimal(F.col("s"), 10, 4, 0, 60)
    return rows.select("event_id", value.alias("v"), issue.alias("issue"))


@query(
    "sc08_strict_json_rows",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def sc08(spark, sf):
    parsed = F.from_json("props", "k bigint", {"mode": "FAILFAST"})
    return load(spark, sf, "events").select("event_id", F.inline(F.array(parsed)))


@query(
    "dm52_audited_normalization",
    """WITH t AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT event_id, CASE WHEN k < 50 THEN k END AS k, CASE WHEN k >= 50 THEN 'k out of range' END AS issue FROM t""",
)
def dm52(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    issues = F.array_compact(F.array(F.when(F.get_json_object("props", "$.k").isNotNull() & (k.isNull() | (k >= 50)), F.lit("k out of range"))))
    rows = load(spark, sf, "events").select("event_id", F.when(k < 50, k).alias("k"), issues.alias("issues"))
    return rows.select("event_id", "k", F.get("issues", 0).alias("issue"))
