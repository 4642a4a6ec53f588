"""Relational operators on small fixtures with known answers."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldbook.operators import relops


def test_latest_is_independent_of_partitions(spark):
    rows = [(k % 5, k, f"v{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "key int, at int, v string")
    a = {tuple(r) for r in relops.latest_per_key(df.repartition(7), ["key"], [F.desc("at")]).collect()}
    assert a == {(k, 95 + k, f"v{95 + k}") for k in range(5)} == {tuple(r) for r in relops.latest_per_key(df.coalesce(1), ["key"], [F.desc("at")]).collect()}


def test_newest_non_null_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, None), ("b", 1, None)], "k string, at int, v string")
    got = {r.k: r.v for r in df.groupBy("k").agg(relops.newest_non_null("v", "at").alias("v")).collect()}
    assert got == {"a": "y", "b": None}


def test_an_empty_snapshot_is_evidence(spark):
    captures = spark.createDataFrame([("arsenal", 1), ("arsenal", 2), ("burnley", 1)], "team string, at int")
    content = spark.createDataFrame([("arsenal", 1, "one"), ("burnley", 1, "two")], "team string, at int, player string")
    now = relops.snapshot_left_join(captures, ["team"], ["at"], [F.desc("at")], content, ["team", "at"])
    assert sorted(tuple(r) for r in now.collect()) == [("arsenal", 2, None), ("burnley", 1, "two")]
    before = relops.snapshot_left_join(captures.filter("at <= 1"), ["team"], ["at"], [F.desc("at")], content, ["team", "at"])
    assert ("arsenal", 1, "one") in [tuple(r) for r in before.collect()]


def test_as_of_is_strict_and_ignores_the_future(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5), ("b", 10), ("a", 1)], "k string, t int")
    marks = [("a", 1, "p"), ("a", 4, "q"), ("a", 5, "r"), ("a", 10, "s")]
    run = lambda some, strict=True: {(r.k, r.t): r.v for r in relops.as_of_backward(left, spark.createDataFrame(some, "k string, at int, v string"), "k", "t", "at", {"v": "v"}, strict).collect()}
    assert run(marks) == {("a", 10): "r", ("a", 5): "q", ("b", 10): None, ("a", 1): None}
    assert run(marks, strict=False) == {("a", 10): "s", ("a", 5): "r", ("b", 10): None, ("a", 1): "p"}
    assert run(marks + [("a", 99, "late"), ("b", 11, "late")]) == run(marks)


def test_as_of_takes_null_payloads_as_marks(spark):
    left = spark.createDataFrame([("a", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, at int, v string")
    assert relops.as_of_backward(left, right, "k", "t", "at", {"v": "v"}).first().v is None


def test_lineage(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 9)], "id long, parent long")
    got = {r.node: (r.root, r.depth) for r in relops.lineage(edges, "id", "parent").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 9: (9, 0)}


def test_grain_and_two_sides(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert [tuple(r) for r in relops.grain_violations(df, ["a", "b"]).collect()] == [(1, 2, 2)]
    sides = relops.two_sided(df.limit(1), ["a"], {"team": "a"}, {"team": "b"}).collect()
    assert sorted((r.venue, r.team) for r in sides) == [("away", 2), ("home", 1)]


@pytest.mark.parametrize("order", [1, 3])
def test_digest_ignores_order(spark, order):
    rows = [(1, "a"), (2, None), (3, "c")]
    df = spark.createDataFrame(rows[order - 1 :] + rows[: order - 1], "x int, y string")
    assert df.agg(*relops.digest(df, ["x", "y"])).first() == spark.createDataFrame(rows, "x int, y string").agg(*relops.digest(df, ["x", "y"])).first()


def test_digest_sees_every_row(spark):
    rows = [(k, f"v{k}") for k in range(60)]
    run = lambda some: tuple(spark.createDataFrame(some, "x int, y string").agg(*relops.digest(spark.createDataFrame(rows, "x int, y string"), ["x", "y"])).first())
    changed = [run([r if k != at else (r[0], "other") for k, r in enumerate(rows)]) for at in range(0, 60, 7)]
    assert len({run(rows), *changed, run([*rows, rows[0]]), run([(0, "~"), *rows[1:]]), run([(0, None), *rows[1:]])}) == len(changed) + 4


def test_buckets_change_nothing(spark):
    left = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 211).cast("int").alias("t"), F.col("id"))
    right = spark.range(90).select((F.col("id") % 2).alias("k"), (F.col("id") * 13 % 199).cast("int").alias("at"), F.col("id").alias("v"))
    for strict in (True, False):
        a, b = (relops.as_of_backward(left, right, "k", "t", "at", {"v": "v", "at": "seen"}, strict, how) for how in (None, lambda t: F.floor(t / 10)))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 400


def test_global_row_number(spark):
    from fieldbook.session import scratch

    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("x"), "id")
    got = relops.global_row_number(df, [F.desc("x"), F.col("id")], "place", scratch(spark, "ranked")).collect()
    want = {r: k for k, r in enumerate(sorted(((r.x, r.id) for r in got), key=lambda p: (-p[0], p[1])), 1)}
    assert all(want[r.x, r.id] == r.place for r in got)


def test_pairs_are_single_and_agree(spark):
    left = spark.createDataFrame([(1, "H", 0.5), (2, "D", 0.2), (3, "A", 0.1)], "id int, outcome string, p double")
    right = spark.createDataFrame([(1, "H", 0.4), (2, "D", 0.3), (9, "A", 0.9)], "id int, outcome string, q double")
    assert sorted(tuple(r) for r in relops.paired(left, right, ["id"], ["outcome"]).collect()) == [(1, "H", 0.5, 0.4), (2, "D", 0.2, 0.3)]
    with pytest.raises(PySparkException, match="several rows of 2"):
        relops.paired(left, right.unionByName(right.filter("id = 2")), ["id"], ["outcome"]).collect()
    with pytest.raises(PySparkException, match="disagree: 1"):
        relops.paired(left, right.withColumn("outcome", F.when(F.col("id") == 1, "A").otherwise(F.col("outcome"))), ["id"], ["outcome"]).collect()


def test_scopes(spark):
    df = spark.createDataFrame([("v1", 1), ("v2", 2), ("v3", 3)], "v string, x int")
    run = lambda scope, current=None: sorted(r.x for r in relops.in_scope(df, "v", scope, current).collect())
    assert (run("all"), run("none"), run(["v3", "v1"]), run("current", df.filter("x = 2"))) == ([1, 2, 3], [], [1, 3], [2])
    for wrong in (["v9"], "v1", "current"):
        with pytest.raises(ValueError):
            run(wrong)
