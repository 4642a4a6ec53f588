"""Fingerprints and components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from fieldbook.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(x) for x in range(len(prints))]


def test_every_three_bits_are_covered():
    for masks in [simhash.MASKS, *simhash.INNER_MASKS]:
        draw = random.Random(0)
        for _ in range(3000):
            differ = sum(1 << b for b in draw.sample(range(64), 3))
            outer = masks is simhash.MASKS
            table = simhash.INNER_MASKS.index(masks) if not outer else None
            inside = differ & ~simhash.MASKS[table] if table is not None else differ
            assert any(inside & m == 0 for m in masks)


def test_against_all_pairs(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((-1 if i is None else i, f"{p:016x}", least.get(r, -1)) for (i, _), p, r in zip(rows, prints, root))
    assert sorted((-1 if i is None else i, f, -1 if c is None else c) for i, f, c in got) == want
    assert len({c for _, _, c in got}) < len(got)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 4)
    draw = random.Random(3)
    prints = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(60):
            at ^= sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3, 4])))
            prints.add(at)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = simhash.connected_components(simhash.fingerprint_links(nodes)).collect()
    root_of = {int(np.int64(r.node).astype(np.uint64)): r.root for r in found}
    got, want = {}, {}
    for p, r in zip(prints, components(prints)):
        got.setdefault(root_of.get(p, ("alone", p)), set()).add(p)
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(want) < len(prints)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.deduplicate(no_docs).collect() == []


def test_deduplicate_keeps_one_of_each_component(docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
