"""The evidence store, small files, streams and the namespace."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import verify
from fieldbook.plans.namespace import Namespace, Relation
from fieldbook.session import scratch
from fieldbook.sources import canonical, evidence, files
from fieldbook.streaming import incremental


def request(day, **more):
    return {"provider": "p", "retrieved_at": f"2026-01-{day:02d}T00:00:00+00:00", "evidence_basis": "b", "source_sha256": f"s{day}", **more}


def teams(spark, *rows):
    return spark.createDataFrame(rows, "team_id string, name string, api_id long")


@pytest.fixture
def root(spark):
    return scratch(spark, "store")


def test_publish_again_is_no_op_and_other_rows_are_another_batch(spark, root):
    a = evidence.publish(spark, root, request(1), {"teams": teams(spark, ("a", "A", 1), ("b", "B", 2))})
    assert evidence.publish(spark, root, request(1), {"teams": teams(spark, ("b", "B", 2), ("a", "A", 1)).repartition(3)}) == a
    assert evidence.publish(spark, root, request(1), {"teams": teams(spark, ("a", "A", 1))})["batch_id"] != a["batch_id"]


def test_only_listed_files_are_visible(spark, root):
    manifest = evidence.publish(spark, root, request(1), {"teams": teams(spark, ("a", "A", 1))})
    stray = f"{root}/parquet/teams/{manifest['batch_id']}x"
    evidence.Dataset(spark, root, tables=["teams"]).observations("teams").write.parquet(stray)
    assert evidence.Dataset(spark, root, tables=["teams"]).observations("teams").count() == 1
    assert evidence.verify_files(spark, root, [manifest]) == []
    manifest["files"][0]["sha256"] = "0"
    assert evidence.verify_files(spark, root, [manifest]) == [manifest["files"][0]["path"]]


def test_cutoff_and_corrections(spark, root):
    evidence.publish(spark, root, request(1), {"teams": teams(spark, ("a", "Old", 1))})
    evidence.publish(spark, root, request(3), {"teams": teams(spark, ("a", "New", None))})
    at = lambda day: [r.name for r in evidence.Dataset(spark, root, f"2026-01-{day:02d}T12:00:00+00:00", tables=["teams"]).current("teams").collect()]
    assert (at(2), at(3)) == (["Old"], ["New"])
    with pytest.raises(ValueError):
        evidence.Dataset(spark, root, "2026-01-02T00:00:00")
    with pytest.raises(KeyError):
        evidence.Dataset(spark, root, tables=["teams"]).observations("players")


def test_players_keep_their_newest_known_values(spark, root):
    row = lambda name, born, code: spark.createDataFrame([("p1", name, born, code)], "player_id string, name string, birth_date string, fpl_code string").withColumn("birth_date", F.to_date("birth_date"))
    evidence.publish(spark, root, request(1), {"players": row("Full Name", "2000-01-01", None)})
    evidence.publish(spark, root, request(2), {"players": row("Short", None, "77")})
    r = evidence.Dataset(spark, root, tables=["players"]).current("players").first()
    assert (r.name, str(r.birth_date), r.fpl_code) == ("Full Name", "2000-01-01", "77")


@pytest.mark.parametrize("table,columns,rows", [
    ("odds", "match_id string, family string, home_odds double, draw_odds double, away_odds double", [("m", "f", 1.0, 3.0, 4.0)]),
    ("odds", "match_id string, family string, home_odds double, draw_odds double, away_odds double", [("m", "f", float("inf"), 3.0, 4.0)]),
    ("fixtures", "match_id string, home_team_id string, away_team_id string, status string", [("m", "a", "b", "finished")]),
    ("standings", "competition_id string, season_id string, team_id string, played int, wins int, draws int, losses int", [("c", "s", "t", 3, 1, 1, 0)]),
    ("teams", "team_id string, name string", [("a", "x"), ("a", "y")]),
    ("teams", "team_id string, colour string", [("a", "x")]),
    ("nothing", "a string", [("a",)]),
])
def test_bad_batches_leave_nothing(spark, root, table, columns, rows):
    with pytest.raises(ValueError):
        evidence.publish(spark, root, request(1), {table: spark.createDataFrame(rows, columns)})
    assert files.listed(spark, f"{root}/manifests", ".json") == []


def test_compaction_keeps_what_is_visible(spark, root):
    made = [evidence.publish(spark, root, request(d), {"teams": teams(spark, ("a", f"A{d}", 1), ("b", "B", 2))}) for d in (1, 2)]
    base = evidence.compact(spark, root, made, ["teams"])
    for cutoff in ("2026-01-01T12:00:00+00:00", None):
        old, new = (evidence.Dataset(spark, root, cutoff, tables=["teams"], manifests=m).current("teams") for m in (made, [base]))
        assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


def test_every_table_has_keys_and_predicates():
    for table in canonical.COLUMNS:
        assert set(canonical.KEYS[table]) <= set(canonical.schema(table).names)
    assert set(canonical.INVALID) <= set(canonical.COLUMNS)


def test_write_once_and_pointers(spark, root):
    files.write_once(spark, f"{root}/a.json", "x")
    files.write_once(spark, f"{root}/a.json", "x")
    with pytest.raises(ValueError):
        files.write_once(spark, f"{root}/a.json", "y")
    for n in range(3):
        assert files.update_pointer(spark, f"{root}/p", lambda d: {"n": d.get("n", 0) + 1}) == {"n": n + 1}
    assert files.read_pointer(spark, f"{root}/p") == {"n": 3} and files.read_pointer(spark, f"{root}/none") == {}


def test_csv(spark, tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data)
        return f"file://{tmp_path}/{name}"

    rows = files.csv_rows(spark, write("a.csv", "﻿Home,Away\nÀ,b\n\n,\nc,\n".encode()), ["Home"]).collect()
    assert [tuple(r) for r in rows] == [("À", "b", 2), ("c", "", 5)]
    assert files.csv_rows(spark, write("b.csv", "Home\né\n".encode("cp1252")), ["Home"]).first().Home == "é"
    with pytest.raises(ValueError):
        files.csv_rows(spark, write("c.csv", b"Home\na,b\n"), ["Home"])
    with pytest.raises(ValueError):
        files.csv_rows(spark, write("d.csv", b"Home\na\n"), ["Away"])


def test_stream_equals_batch(spark, root):
    rows = spark.range(500).select((F.col("id") % 9).alias("k"), F.col("id").alias("at"))
    rows.repartition(4).write.parquet(f"{root}/in")
    got = incremental.run_current_view(incremental.read_events(spark, f"{root}/in", rows.schema), ["k"], [F.desc("at")], root)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, max(x for x in range(500) if x % 9 == k)) for k in range(9))


def test_refresh_actions():
    base = {"fit": "1", "projection": "1", "market": "1", "display": "1"}
    act = lambda **change: incremental.refresh_action(base, base | change)
    assert (act(), act(display="2"), act(market="2"), act(market="2", display="2"), act(fit="2", market="2")) == ("idle", "display", "market", "market_display", "full")


def test_namespace(spark):
    space = Namespace(spark, [Relation("numbers", "number", "Some numbers.", spark.range(30)), Relation("words", "word", "Long words.", spark.createDataFrame([("x" * 500, 1 / 3)], "w string, f double"))])
    assert space.sql("SELECT count(*) AS n FROM analysis_numbers WHERE id < :m", {"m": 5}).first().n == 5
    assert {r.object_name for r in space.catalog().collect()} == {r.object_name for r in space.column_catalog().collect()}
    out = space.bounded({"a": "SELECT * FROM analysis_numbers", "b": "SELECT * FROM analysis_words"}, max_rows=10, max_chars=9)
    assert out["a"]["truncated"] and len(out["a"]["rows"]) == 10
    assert out["b"]["rows"] == [["xxxxxxxx…", 0.333333]] and not out["b"]["truncated"]
    with pytest.raises(ValueError):
        Namespace(spark, [Relation("a", "", "", spark.range(1)), Relation("a", "", "", spark.range(1))])


def test_a_view_goes_on_from_its_checkpoint(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = spark.createDataFrame([(k % 40, k, f"v{k}") for k in range(100)], "k int, at int, v string")
    run = lambda: {r.k: r.v for r in incremental.run_current_view(incremental.read_events(spark, f"{root}/in", first.schema), ["k"], [F.desc("at")], root).collect()}
    first.repartition(3).write.parquet(f"{root}/in")
    want = {k % 40: f"v{k}" for k in range(100)}
    assert run() == want
    assert run() == want  # nothing new
    spark.createDataFrame([(3, 500, "late"), (77, 501, "new"), (4, -1, "old")], first.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert run() == want | {3: "late", 77: "new"} == run()


def test_a_stream_without_rows(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([], "k int, at timestamp")
    rows.write.parquet(f"{root}/in")
    assert incremental.run_current_view(incremental.read_events(spark, f"{root}/in", rows.schema), ["k"], [F.desc("at")], f"{root}/a").collect() == []


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    root = f"file://{tmp_path}"
    days = lambda *some: spark.createDataFrame([("x", f"2024-01-{d:02d} 12:00:00") for d in some], "k string, at string").select("k", F.col("at").cast("timestamp").alias("at"))
    run = lambda: {r.start.day: r.n for r in incremental.run_window_counts(incremental.read_events(spark, f"{root}/in", days(1).schema), "at", "1 day", "2 days", ["k"], root).collect()}
    days(1, 1, 2).coalesce(1).write.parquet(f"{root}/in")
    assert run() == {1: 2, 2: 1}
    days(20).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert run() == {1: 2, 2: 1, 20: 1} == run()
    days(1, 19, 20).coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert run() == {1: 2, 2: 1, 19: 1, 20: 2}  # the first is too late


def test_private_values_in_maps_and_deep_arrays(spark):
    schema = "id int, m map<string,string>, deep array<struct<a:array<string>,n:map<string,struct<t:string>>>>"
    rows = [(1, {"k": "secret 7"}, None), (2, {"secret 8": "x"}, []), (3, None, [(["ok", "secret 9"], None)]), (4, None, [(None, {"k": ("secret 1",)})]), (5, {"k": "fine"}, [(["fine"], {"k": ("fine",)})])]
    documents = spark.createDataFrame(rows, schema)
    names = {"id", "m", "deep", "a", "n", "t"}
    found = verify.unpublishable(documents, names, ["private"], ["secret [0-9]"], "id").collect()
    assert sorted((r.subject, r.path) for r in found) == [("1", "$.m{}"), ("2", "$.m{key}"), ("3", "$.deep[].a[]"), ("4", "$.deep[].n{}.t")]
