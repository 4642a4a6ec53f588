"""Links and components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fieldbook.llm import embeddings


def plain(rows, bound=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    near = [{j for j in range(len(rows)) if j != i and a is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(a) == len(unit[j]) and a @ unit[j] >= bound} for i, a in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return sorted((a, n, c, a == c) for a, n, c in out)


def vectors(n, dim=16, groups=12, seed=0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(groups, dim))
    rows = []
    for k in range(n):
        v = draw.normal(size=dim) if k % 3 else centers[draw.integers(groups)] + draw.normal(size=dim) * draw.choice([0.05, 0.25])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 4 > 2)))
    return rows


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, [1.0] * 16, None), (906, [1.0] * 16, 7), (907, [2.0] * 16, 7), (908, [1.0] * 4, 7), (909, [], 7), (910, [1e-200] * 16, 7), (911, [1e200] * 16, 7)]


def run(spark, rows):
    kind = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, kind).selectExpr("*", "'x' AS key", "1 AS node", "2 AS vec")
    return sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())


def test_against_all_pairs(spark):
    rows = vectors(400) + [(500 + k, vectors(9)[3][1], 0) for k in range(30)] + ODD
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("limits", [{"SHARD_ROWS": 60}, {"SHARD_ROWS": 40, "CHILDREN": 3, "_PART_ROWS": 50}, {"SHARD_ROWS": 30, "LARGEST": 40, "BLOCK": 16}])
def test_shards_and_tiles(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(embeddings, name, value)
    rows = vectors(900, seed=5)
    random.Random(0).shuffle(rows)
    got, want = run(spark, rows), plain(rows)
    true, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and found >= 0.97 * true
    assert sum(a[2] == b[2] for a, b in zip(got, want)) >= 0.97 * len(rows)


def straddling(pairs=300, dim=16):
    """Pairs at cosine 0.94, their middle on the border of two centroids."""
    draw = np.random.default_rng(3)
    centers = embeddings.unit(draw.normal(size=(2, dim)))
    across = embeddings.unit((centers[0] - centers[1])[None])[0]
    half = np.arccos(0.94) / 2
    rows = []
    for _ in range(pairs):
        middle = centers.sum(0) + 0.3 * draw.normal(size=dim)
        middle = middle - (middle @ across) * across
        middle = middle / np.linalg.norm(middle)
        rows += [np.cos(half) * middle + np.sin(half) * across, np.cos(half) * middle - np.sin(half) * across]
    return np.array(rows), centers


def test_linked_rows_share_a_home():
    points, centers = straddling()
    home, shards = embeddings.shards_of(points, centers)
    assert (home[::2] == 0).all() and (home[1::2] == 1).all()
    near = np.argwhere(points @ points.T >= 0.93)
    assert len(near) > len(points)
    assert all(shards[j][home[i]] or shards[i][home[j]] for i, j in near)


def test_links_over_a_border(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 300)
    points, centers = straddling()
    monkeypatch.setattr(embeddings, "kmeans", lambda p, k, rounds=8: centers)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(points)]
    got, want = run(spark, rows), plain(rows)
    assert [r[1] for r in got] == [r[1] for r in want] and [r[2] for r in got] == [r[2] for r in want]


def test_audit(spark):
    rows = spark.createDataFrame(vectors(500, seed=2), "vec_id long, embedding array<double>, label int")
    assert embeddings.audit_recall(rows, embeddings.near_duplicates(rows)) >= 0.99


def test_graph_reaches_what_is_near():
    points = embeddings.unit(np.array([v for _, v, _ in vectors(600, seed=9)]))
    lists = embeddings.build_graph(points)
    assert lists.shape == (600, embeddings.DEGREE) and not (lists == np.arange(600)[:, None]).any()
    found = embeddings.range_search(points, lists, embeddings.medoids(points), np.arange(600), 0.93)
    true = points @ points.T >= 0.93
    np.fill_diagonal(true, False)
    hit = sum(true[i][x].sum() for i, x in enumerate(found))
    assert hit == sum(map(len, found)) and hit >= 0.99 * true.sum()


def test_pruned_lists_against_plain():
    points = embeddings.unit(np.random.default_rng(1).normal(size=(200, 8)))
    pool = np.random.default_rng(2).integers(-1, 200, (5, 60))
    far = lambda a, b: np.sqrt(max(2 - 2 * points[a] @ points[b], 0))
    for at, row, got in zip(range(5), pool, embeddings.robust_prune(points, np.arange(5), pool)):
        want: list[int] = []
        for x in sorted(set(row.tolist()) - {-1, at}, key=lambda x: far(at, x)):
            if len(want) < embeddings.DEGREE and all(embeddings.ALPHA * far(k, x) > far(at, x) for k in want):
                want.append(x)
        others = [x for x in sorted(set(row.tolist()) - {-1, at}, key=lambda x: far(at, x)) if x not in want]
        assert got[got >= 0].tolist() == [*want, *others][: embeddings.DEGREE]


def test_near_copies_of_one_vector(spark):
    """A ball around one vector: its copies must not be lost behind it."""
    draw = np.random.default_rng(7)
    base = draw.normal(size=(3, 32))
    points = embeddings.unit(np.concatenate([base, *[b + draw.normal(size=(400, 32)) * 0.12 for b in base]]))
    found = embeddings.range_search(points, embeddings.build_graph(points), embeddings.medoids(points), np.arange(len(points)), 0.93)
    true = points @ points.T >= 0.93
    np.fill_diagonal(true, False)
    assert true.sum() > 10_000 and sum(map(len, found)) >= 0.999 * true.sum()


def test_splits_lose_no_pair_and_count_each_once(spark, monkeypatch):
    for name, value in {"SHARD_ROWS": 40, "CHILDREN": 4, "_PART_ROWS": 64}.items():
        monkeypatch.setattr(embeddings, name, value)
    rows = [(k, v, 0) for k, (_, v, _) in enumerate(vectors(700, dim=6, groups=40, seed=3))]
    _, nodes = embeddings.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label")
    found = embeddings.split(nodes).collect()
    assert max(len(r.homes) for r in found) > 1
    points = {r.node: np.frombuffer(bytes(r.vec)) for r in found}
    ids = sorted(points)
    matrix = np.array([points[i] for i in ids])
    linked = {(ids[a], ids[b]) for a, b in np.argwhere(matrix @ matrix.T >= 0.93) if a < b}
    count = dict.fromkeys(linked, 0)
    for shard in {r.shard for r in found}:
        own = [r for r in found if r.shard == shard]
        check = embeddings._owned(shard, [r.homes for r in own], [r.masks for r in own])
        for i, r in enumerate(own):
            for j in np.flatnonzero(check(i, np.arange(len(own)))).tolist():
                if (pair := (r.node, own[j].node)) in count:
                    count[pair] += 1
    assert len(linked) > 500 and set(count.values()) == {1}


def test_empty_table(spark):
    assert run(spark, []) == []
