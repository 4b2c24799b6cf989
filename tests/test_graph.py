"""Connected components against union-find."""

from __future__ import annotations

import random

from mediagauge.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_chains_stars_and_repeats(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(5000, 5001)] * 5 + [(77777, 77777)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["id"]: r["root"] for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_strings_and_empty(spark):
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string"), "x", "y").collect()
    assert {(r["id"], r["root"]) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
