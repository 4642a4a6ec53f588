"""Connected components of chains, stars, cycles and odd edges."""

from __future__ import annotations

import random

from fieldbook.llm.common import connected_components


def run(spark, edges):
    return {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_shapes(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    found = run(spark, chain + star + [(5, 5), (None, 3), (300, 301), (301, 302), (302, 300), (7, 200)])
    assert {found[k] for k in range(100, 161)} == {100}
    assert {found[k] for k in range(200, 260)} == {7} and found[7] == 7
    assert found[302] == 300 and found[5] == 5 and 3 not in found


def test_random(spark):
    draw = random.Random(1)
    edges = [(draw.randint(-150, 150), draw.randint(-150, 150)) for _ in range(150)]
    found = run(spark, edges)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in near:
        seen, stack = {start}, [start]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        assert found[start] == min(seen)


def test_no_edges(spark):
    assert run(spark, []) == {}
