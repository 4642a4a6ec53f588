"""The smallest capacity against a plain search, atomic groups, and slots."""

from __future__ import annotations

import random
import zlib

import pytest

from fieldbook.llm import sharding


def least_capacity(sizes, shards):
    def needed(capacity):
        count, filled = 1, 0
        for size in sizes:
            if filled + size > capacity:
                count, filled = count + 1, 0
            filled += size
        return count

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("spread", [2**63 - 1, 10**6, 300])
def test_capacity_is_least(spark, spread):
    draw = random.Random(spread)
    for n, most in ((2, 9), (60, 1000), (250, 5)):
        keys = sorted({draw.randint(-spread, spread) for _ in range(n)})
        sizes = [draw.randint(1, most) for _ in keys]
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, total long")
        capacity, cuts = sharding.minimax_cuts(groups, 5)
        assert capacity == least_capacity(sizes, 5)
        parts = [sum(s for k, s in zip(keys, sizes) if sum(c <= k for c in cuts) == shard) for shard in range(len(cuts) + 1)]
        assert max(parts) == capacity and len(cuts) < 5


def test_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + k, "a large group " * 20) for k in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "8 AS key"), shards=4).collect()
    assert len(got) == len(rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t or "")
    homes = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
        assert (r["size"], r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text[r.doc_id]}
        homes.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_large_groups_have_their_own_shards(spark):
    rows = [(k, "x" * 10_000) for k in range(40)] + [(k, f"small {k}") for k in range(40, 400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    assert len(sums) == 8 and sorted(sums.values())[-2] < 1.1 * sorted(sums.values())[0] + 20


def test_empty_table(no_docs):
    assert sharding.shard(no_docs).collect() == []
