"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are compared only within one label (and dimension). Equal vectors of a label are one
node. A shard, at first a whole label, of more than ``SHARD_ROWS`` nodes is split around up to
``CHILDREN`` centroids of a sample of it, and so on: a node belongs to its nearest centroid and to
each other one whose border is within half the greatest distance of a linked pair. The border
lies between the two ends of a pair whose nearest centroids differ, so one end at least is in
the other's part: no pair is lost to a split, at any depth. Centroids travel as rows ahead of
the nodes of their shard, so neither the driver nor any one task holds those of all shards.

Each shard builds a flat graph by insertion: batches of nodes search the graph so far, take
what they met as their neighbours after robust pruning (an edge goes if a kept neighbour is
``ALPHA`` times nearer to its end), and give reverse edges, ``DEGREE`` at most (Subramanya et
al., "DiskANN", 2019; Manohar et al., "ParlayANN", 2024). The adjacency lists of a node's
shards are united. Every node then runs a greedy search in its shards, from the shard's
medoids and its own place, that expands over everything within the range (Manohar et al.,
"Range retrieval with graph-based indices", 2025); what it meets is verified by the cosine in
double precision, so no pair below the bound is linked.

Each shard audits its recall against all others on one node in ``AUDIT_EVERY``; if it finds
less than ``LEAST_RECALL`` of their links, it compares all its pairs. Nodes so dense that a split
does not part them stay one shard; one of more than ``LARGEST`` rows is never one task: its
blocks are compared tile by tile, exactly.

Centroids come from samples of about ``SAMPLE`` nodes a shard; all nodes are indexed and
searched. Null labels, and vectors that are null, empty, zero or hold a null or non-finite
component, link with nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import connected_components, cut, drop, map_arrow

COSINE = 0.93
SHARD_ROWS = 8192
LARGEST = 16384
BLOCK = 4096
SAMPLE = 8192
FAN = 64  # a set of a shard's children is the bits of a long
CHILDREN = 64  # of a shard at most
DEGREE = 24
POOL = 64
ALPHA = 1.2
BEAM = 24
MEDOIDS = 8
AUDIT_EVERY = 20
LEAST_RECALL = 0.99
_PART_ROWS = 1 << 16
_BATCH = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length, from unit vectors; the same for the same input."""
    points = points[np.lexsort(points.T[:4])]
    centers = points[np.random.default_rng(0).choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(points[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(points), 4096)])
        total = np.zeros_like(centers)
        np.add.at(total, near, points)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centers = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centers)
    return centers


def overlap(bound: float) -> float:
    """Half the distance of two unit vectors at the bound, with room for rounding."""
    return math.sqrt(max(2 - 2 * bound, 0)) / 2 + 1e-6


def shards_of(points: np.ndarray, centers: np.ndarray, bound: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """The home of each unit vector, and whether it is in each shard; linked ones share a home."""
    dots = points @ centers.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0))
    margin = (dots[np.arange(len(points)), home][:, None] - dots) / np.maximum(apart[home], 1e-9)
    margin[np.arange(len(points)), home] = 0
    return home, margin <= overlap(bound)


def robust_prune(points: np.ndarray, at: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """For each row ``at`` at most ``DEGREE`` of its pool: those not behind a kept one, nearest
    first, then the nearest others while there is room, so that a ball of near copies around
    one node does not hang on that node alone. ``pool`` and the result pad with -1.
    """
    pool = np.sort(pool, axis=1)
    bad = (pool < 0) | (pool == at[:, None])
    bad[:, 1:] |= pool[:, 1:] == pool[:, :-1]
    near = np.where(bad, -3, np.einsum("ijk,ik->ij", points[pool], points[at]))
    order = np.argsort(-near, axis=1, kind="stable")[:, :POOL]
    pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
    vectors = points[pool]
    between = ALPHA**2 * (2 - 2 * vectors @ vectors.transpose(0, 2, 1))
    far = 2 - 2 * near
    there = near > -3
    alive, kept, n = there.copy(), np.zeros(pool.shape, bool), np.zeros(len(at), int)
    for k in range(pool.shape[1]):
        kept[:, k] = alive[:, k] & (n < DEGREE)
        n += kept[:, k]
        alive &= ~kept[:, k, None] | (between[:, k] > far)
    first = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :DEGREE]
    return np.take_along_axis(np.where(there, pool, -1), first, 1)


def beam(points: np.ndarray, table: np.ndarray, entries: np.ndarray, target: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for each target from its entries: the nearest rows met and their cosines.

    Lists and results pad with -1 and -3.
    """
    rows, n = np.arange(len(target)), len(points)
    ids = np.sort(entries, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    near = np.where(ids >= 0, np.einsum("ijk,ik->ij", points[ids], target), -3)
    done = ids < 0
    met = np.zeros((len(target), n + 1), bool)  # the last column is that of the padding
    met[rows[:, None], ids] = True
    met[:, n] = True
    for _ in range(4 * width):
        pick = np.where(done, -3, near)
        best = pick.argmax(1)
        live = pick[rows, best] > -3
        if not live.any():
            break
        done[rows, best] = True
        new = np.where(live[:, None], table[ids[rows, best]], -1)
        new = np.where(met[rows[:, None], new], -1, new)
        met[rows[:, None], new] = True
        score = np.where(new >= 0, np.einsum("ijk,ik->ij", points[new], target), -3)
        ids, near, done = np.concatenate([ids, new], 1), np.concatenate([near, score], 1), np.concatenate([done, new < 0], 1)
        if ids.shape[1] > width:
            keep = np.argpartition(-near, width - 1, axis=1)[:, :width]
            ids, near, done = (np.take_along_axis(x, keep, 1) for x in (ids, near, done))
    return ids, near


def build_graph(points: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency lists over the rows of unit vectors, by insertion; padded with -1."""
    n = len(points)
    points = points.astype(np.float32)
    table = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    entry = order[: min(n, MEDOIDS)]
    at, size = 0, 2 * MEDOIDS
    while at < n:
        batch = order[at : at + size]
        mates = batch[np.argsort(-(points[batch] @ points[batch].T), axis=1)[:, : DEGREE // 2]]
        if at:
            met, _ = beam(points, table, np.broadcast_to(entry, (len(batch), len(entry))), points[batch])
            mates = np.concatenate([met, mates], 1)
        table[batch] = _fit(robust_prune(points, batch, mates))
        # Reverse edges: each end gets what points to it, and is pruned if that is too much.
        source, end = np.repeat(batch, DEGREE), table[batch].ravel()
        source, end = source[end >= 0], end[end >= 0]
        by = np.lexsort((-np.einsum("ij,ij->i", points[source], points[end]), end))
        source, end = source[by], end[by]
        ends, first = np.unique(end, return_index=True)
        place = np.arange(len(end)) - np.repeat(first, np.diff(np.r_[first, len(end)]))
        kept = place < 2 * DEGREE
        more = np.full((len(ends), 2 * DEGREE), -1, np.int64)
        more[np.searchsorted(ends, end[kept]), place[kept]] = source[kept]
        for a in range(0, len(ends), _BATCH):
            some = ends[a : a + _BATCH]
            table[some] = _fit(robust_prune(points, some, np.concatenate([table[some], more[a : a + _BATCH]], 1)))
        at, size = at + len(batch), min(_BATCH, 2 * size)
    return table


def _fit(lists: np.ndarray) -> np.ndarray:
    return np.pad(lists, ((0, 0), (0, DEGREE - lists.shape[1])), constant_values=-1)


def medoids(points: np.ndarray) -> np.ndarray:
    """The rows nearest to the centres of the shard's parts."""
    step = max(1, len(points) // 2048)
    return np.unique((kmeans(points[::step], min(MEDOIDS, len(points)), 3) @ points.T).argmax(1))


def range_search(points: np.ndarray, table: np.ndarray, entries: np.ndarray, queries: np.ndarray, bound: float) -> list[np.ndarray]:
    """For each query row the rows met that are within the bound. ``table`` pads its lists with -1."""
    found: list[np.ndarray] = []
    loose, rough = bound - 0.02, points.astype(np.float32)
    for a in range(0, len(queries), _BATCH):
        q = queries[a : a + _BATCH]
        start = np.concatenate([np.broadcast_to(entries, (len(q), len(entries))), q[:, None]], axis=1)
        ids, near = beam(rough, table, start, rough[q])
        for i in range(len(q)):
            met = np.unique(np.r_[ids[i][(near[i] >= loose) & (ids[i] >= 0)], q[i]])
            front = met
            while len(front):  # the range expands: everything near that a near row points to
                step = np.unique(table[front])
                step = np.setdiff1d(step[step >= 0], met, assume_unique=True)
                front = step[rough[step] @ rough[q[i]] >= loose]
                met = np.union1d(met, front)
            met = met[met != q[i]]
            found.append(met[points[met] @ points[q[i]] >= bound])
    return found


def _padded(lists: list[list[int]]) -> np.ndarray:
    table = np.full((len(lists), max([1, *map(len, lists)])), -1, np.int64)
    for i, row in enumerate(lists):
        table[i, : len(row)] = row
    return table


def _all_pairs(points: np.ndarray, others: np.ndarray, bound: float) -> list[np.ndarray]:
    return [np.flatnonzero(row >= bound) for a in range(0, len(points), 512) for row in points[a : a + 512] @ others.T]


def shard_links(points: np.ndarray, lists: list[list[int]], bound: float) -> list[np.ndarray]:
    """The linked rows of each row of a shard, with the recall audited."""
    n = len(points)
    found = range_search(points, _padded(lists), medoids(points), np.arange(n), bound)
    sample = np.arange(0, n, AUDIT_EVERY)
    want = got = 0
    for i, true in zip(sample, _all_pairs(points[sample], points, bound)):
        true = true[true != i]
        want, got = want + len(true), got + int(np.isin(true, found[i]).sum())
    if got < LEAST_RECALL * want:
        found = [row[row != i] for i, row in enumerate(_all_pairs(points, points, bound))]
    rows = np.concatenate([np.full(len(x), i) for i, x in enumerate(found)]) if n else np.zeros(0, int)
    ends = np.concatenate(found) if n else np.zeros(0, int)
    pairs = np.unique(np.minimum(rows, ends).astype(np.int64) * n + np.maximum(rows, ends))
    a, b = np.concatenate([pairs // n, pairs % n]), np.concatenate([pairs % n, pairs // n])
    order = np.argsort(a, kind="stable")
    return np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))


def spanning(found: list[np.ndarray]) -> list[int]:
    """The least row of each row's component."""
    root = list(range(len(found)))
    for i in range(len(found)):
        if root[i] != i:
            continue
        stack = [i]
        while stack:
            for j in found[stack.pop()].tolist():
                if root[j] == j and j != i:
                    root[j] = i
                    stack.append(j)
    return root


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def nodes_of(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, key) of every row, and (node, label, key, vec, n, least_id) of the distinct vectors.

    key is null where the row links with nothing. vec is the unit vector as doubles.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.to_json(F.struct(F.col(label_col).alias("l"))).alias("label"), F.col(label_col).isNotNull().alias("has"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for has, v in zip(batch.column(2).to_pylist(), batch.column(3)):
                out.append(None)
                if has and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy()
                    big = np.abs(x).max()
                    if np.isfinite(big) and big > 0:
                        x = x / big  # so that no square overflows or vanishes
                        out[-1] = (x / np.sqrt(x @ x)).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["id", "label", "vec"])

    keyed = map_arrow(rows, run, f"id {kind}, label string, vec binary").withColumn("key", F.sha2("vec", 256))
    keyed = cut(keyed, "vectors")
    nodes = keyed.filter("vec is not null").groupBy("label", "key").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least_id"))
    return keyed, cut(nodes.withColumn("label", F.concat_ws("/", "label", F.octet_length("vec"))).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _children(mask: str) -> str:
    return f"filter(sequence(0, {FAN - 1}), i -> getbit({mask}, i) = 1)"


def _centers(shards: DataFrame) -> DataFrame:
    """(label, shard, centers) from a sample of each shard of (label, shard, size, node, vec)."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("size"))
    drawn = shards.filter(F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 30)) < share * (1 << 30))

    def run(table: pa.Table) -> pa.Table:
        k = min(CHILDREN, max(2, -(-2 * table.column("size")[0].as_py() // SHARD_ROWS)))
        centers = kmeans(_vectors(table.column("vec")), k)
        return pa.table({"label": table.column("label")[:1], "shard": table.column("shard")[:1], "centers": pa.array([centers.tobytes()], pa.binary())})

    return drawn.select("label", "shard", "size", "vec").groupBy("label", "shard").applyInArrow(run, "label string, shard long, centers binary")


def _assigned(shards: DataFrame, large: DataFrame, centers: DataFrame, bound: float) -> DataFrame:
    """The rows of the large shards with the home and the set of children that their centroids give them.

    Each part of a shard begins with a row of its centroids; a part is some of its nodes.
    """
    parts = F.ceil(F.col("size") / _PART_ROWS).cast("int")
    kept = ["homes", "masks", "node", "n", "vec"]
    rows = shards.select("label", "shard", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("rank"), *kept)
    ahead = centers.join(large, ["label", "shard"])
    ahead = ahead.select("label", "shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("rank"), F.col("centers").alias("vec"))
    both = rows.unionByName(ahead, allowMissingColumns=True).repartition("label", "shard", "part").sortWithinPartitions("label", "shard", "part", "rank")

    def run(batches):
        centers = None
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            for a, b in zip(starts := np.unique(np.r_[0, np.flatnonzero(rank == 0)]), np.r_[starts[1:], len(rank)]):
                vec = batch.column("vec")
                if b > a and rank[a] == 0:
                    whole = np.frombuffer(vec[a].as_py(), np.float64)
                    centers, a = whole, a + 1
                if b <= a:
                    continue
                some = batch.slice(a, b - a)
                points = _vectors(some.column("vec"))
                home, member = shards_of(points, centers.reshape(-1, points.shape[1]), bound)
                mask = np.bitwise_or.reduce(member.astype(np.uint64) << np.arange(member.shape[1], dtype=np.uint64), axis=1).view(np.int64)
                homes = [x + [h] for x, h in zip(some.column("homes").to_pylist(), home.tolist())]
                masks = [x + [m] for x, m in zip(some.column("masks").to_pylist(), mask.tolist())]
                columns = [some.column("label"), some.column("shard"), pa.array(homes, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int64())), *[some.column(c) for c in ("node", "n", "vec")]]
                yield pa.RecordBatch.from_arrays(columns, ["label", "shard", *kept])

    return map_arrow(both, run, "label string, shard long, homes array<int>, masks array<long>, node long, n long, vec binary")


def split(nodes: DataFrame, bound: float = COSINE) -> DataFrame:
    """(label, shard, homes, masks, node, n, vec): a row for each final shard that a node is in.

    Child c of shard s is s * FAN + c + 1; homes and masks are a node's home and its set of
    children at each split above.
    """
    by = ["label", "shard"]
    columns = [*by, "homes", "masks", "node", "n", "vec"]
    now = nodes.withColumns({"shard": F.lit(0).cast("long"), "homes": F.array().cast("array<int>"), "masks": F.array().cast("array<long>")}).select(columns)
    done = []
    while True:
        large = cut(now.groupBy(*by).agg(F.count("*").alias("size")).filter(F.col("size") > SHARD_ROWS), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, now])
        done.append(cut(now.join(large, by, "left_anti").select(columns), "shards"))
        shards = now.join(large, by)
        placed = cut(_assigned(shards, large, cut(_centers(shards), "centers"), bound), "placed")
        counts = placed.select(*by, F.explode(F.expr(_children("element_at(masks, -1)"))).alias("child")).groupBy(*by, "child").agg(F.count("*").alias("rows"))
        counts = counts.groupBy(*by).agg(F.max("rows").alias("most"), F.sum("rows").alias("total"))
        # A split that parts little, or that puts nodes into many children, is not made.
        parted = cut(counts.join(large, by).filter("4 * most <= 3 * size and total <= 3 * size").select(by), "parted")
        before = {c: F.expr(f"slice({c}, 1, size({c}) - 1)") for c in ("homes", "masks")}
        done.append(cut(placed.join(parted, by, "left_anti").withColumns(before).select(columns), "shards"))
        children = placed.join(parted, by).withColumn("child", F.explode(F.expr(_children("element_at(masks, -1)"))))
        now = children.withColumn("shard", F.col("shard") * FAN + F.col("child") + 1).select(columns)


_FOUND = "node long, links long, root long"


def _found(nodes, links, roots) -> pa.Table:
    return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})


def _owned(shard: int, homes: list[list[int]], masks: list[list[int]]):
    """Whether a pair of rows is counted here: at every split above, in the least home of the
    two that holds both."""
    path = []
    while shard > 0:
        shard, child = divmod(shard - 1, FAN)
        path.insert(0, child)
    home = np.array(homes, np.uint64).reshape(len(homes), len(path))
    mask = np.array(masks, np.int64).reshape(len(homes), len(path)).view(np.uint64)
    one = np.uint64(1)

    def check(i: int, j: np.ndarray) -> np.ndarray:
        ok = np.ones(len(j), bool)
        for level, child in enumerate(path):
            both = mask[i, level] & mask[j, level]
            mine, other = home[i, level], home[j, level]
            mine = np.where(both >> mine & one, mine, np.uint64(FAN))
            other = np.where(both >> other & one, other, np.uint64(FAN))
            ok &= np.minimum(mine, other) == child
        return ok

    return check


def _build(table: pa.Table) -> pa.Table:
    """A shard's graph: the neighbours of each of its nodes."""
    table = table.sort_by("node")
    node = table.column("node").to_numpy()
    lists = build_graph(_vectors(table.column("vec")))
    return pa.table({"node": table.column("node"), "near": pa.array([node[x[x >= 0]].tolist() for x in lists], pa.list_(pa.int64()))})


def _search(bound: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n = (table.column(c).to_numpy() for c in ("node", "n"))
        row = {int(x): i for i, x in enumerate(node)}
        lists = [[row[x] for x in near if x in row] for near in table.column("near").to_pylist()]
        found = shard_links(_vectors(table.column("vec")), lists, bound)
        owned = _owned(table.column("shard")[0].as_py(), table.column("homes").to_pylist(), table.column("masks").to_pylist())
        links = [int(n[x[owned(i, x)]].sum()) if len(x) else 0 for i, x in enumerate(found)]
        return _found(node, links, node[spanning(found)])

    return run


def _tile(bound: float):
    """All pairs of two blocks of one shard, in slices; a pair counts for both ends."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        side, node, n = (table.column(c).to_numpy() for c in ("side", "node", "n"))
        points = _vectors(table.column("vec"))
        owned = _owned(table.column("shard")[0].as_py(), table.column("homes").to_pylist(), table.column("masks").to_pylist())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
        right = right if len(right) else left
        found = [np.zeros(0, np.int64)] * len(node)
        for i, hits in zip(left, _all_pairs(points[left], points[right], bound)):
            found[i] = right[hits][right[hits] != i]
        if len(right) and right is not left:
            for i, hits in zip(right, _all_pairs(points[right], points[left], bound)):
                found[i] = left[hits]
        links = [int(n[x[owned(i, x)]].sum()) if len(x) else 0 for i, x in enumerate(found)]
        return _found(node, links, node[spanning(found)])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", bound: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts the other rows linked directly, component_id is the least id reachable,
    kept whether it is the row's own. Rows that repeat an id count as rows of their own.
    A row that can link with nothing is its own component; vectors of other lengths are
    other labels. Other columns are ignored; an empty table gives no rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    keyed, nodes = nodes_of(rows, id_col, vec_col, label_col)
    placed = cut(split(nodes, bound), "shards")
    size = placed.groupBy("label", "shard").agg(F.count("*").alias("size"))
    large = cut(size.filter(F.col("size") > LARGEST), "large")
    normal = placed.join(large.select("label", "shard"), ["label", "shard"], "left_anti")
    graph = normal.groupBy("label", "shard").applyInArrow(_build, "node long, near array<long>")
    union = cut(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    found = normal.join(union, "node").groupBy("label", "shard").applyInArrow(_search(bound), _FOUND)
    tiles = placed.join(large, ["label", "shard"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = tiles.withColumn("other", other).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).withColumn("side", F.when(F.col("block") == F.col("one"), 0).otherwise(1))
    found = found.unionByName(tiles.groupBy("label", "shard", "one", "two").applyInArrow(_tile(bound), _FOUND))
    found = cut(found, "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.select("node", "label", "key", "n", "least_id").join(counted, "node", "left").join(roots, "node", "left")
    classes = cut(classes.withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1), "classes")
    least = classes.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = classes.join(least, "root").select(F.regexp_replace("label", "/[0-9]+$", "").alias("label"), "key", "links", "component")
    out = keyed.select("id", "label", "key").join(classes, ["label", "key"], "left")
    component = F.coalesce("component", "id").cast(kind)
    drop(placed)
    drop(union)
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def audit_recall(rows: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", bound: float = COSINE, every: int = 20) -> float:
    """The share of true links found, of the rows whose id is divisible by ``every``.

    Those rows are compared with all others of their label, block by block.
    """
    keyed, _ = nodes_of(rows, id_col, vec_col, label_col)
    queries = keyed.filter((F.col("id") % every == 0) & F.col("vec").isNotNull())
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, queries.count() // 1024)))).select("label", "block", F.col("id").alias("q"), F.col("vec").alias("qv"))
    numbers = blocks.select("label", "block").distinct()
    others = keyed.filter("vec is not null").join(numbers, "label")
    others = others.select(F.col("label").alias("label2"), F.col("block").alias("block2"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("part2"), "vec")

    def count(key, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "true": pa.array([], pa.int64())})
        a, b = _vectors(one.column("qv")), _vectors(two.column("vec"))
        near = (a @ b.T >= bound).sum(1)
        return pa.table({"id": one.column("q").cast(pa.int64()), "true": pa.array(near, pa.int64())})

    spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    true = spread.groupBy("label", "block", "part").cogroup(others.groupBy("label2", "block2", "part2")).applyInArrow(count, "id long, true long")
    true = true.groupBy("id").agg((F.sum("true") - 1).alias("true"))
    row = true.join(found, true["id"] == found[id_col]).agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return 1.0 if not row[0] else row[1] / row[0]


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(other) AS component_id, e.vec_id = min(other) AS kept
FROM embeddings e JOIN reach r ON e.vec_id = r.vec_id GROUP BY e.vec_id"""
