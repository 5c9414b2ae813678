"""Hulls, distances and growth of cells against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest


def told_hull(points):
    """Corners: points that some direction puts strictly first."""
    own = sorted(set(points))
    out = set()
    for p in own:
        for q in own:
            if p != q:
                side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in own]
                along = [(r[0] - p[0]) * (q[0] - p[0]) + (r[1] - p[1]) * (q[1] - p[1]) for r in own]
                most = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2
                if all(s > 0 or (s == 0 and 0 <= a <= most) for s, a in zip(side, along)):
                    out |= {p, q}
    return out


def test_hulls_merge(spark):
    from geoloom.operators.form import convex_hulls

    rng = random.Random(5)
    groups = {k: [(float(rng.randint(0, 12)), float(rng.randint(0, 9))) for _ in range(n)] for k, n in (("a", 60), ("b", 5), ("c", 1), (None, 30))}
    rows = [(k, *p) for k, own in groups.items() for p in own] + [("a", None, 1.0)]
    got = {r["k"]: r for r in convex_hulls(spark.createDataFrame(rows, "k string, x double, y double").repartition(6), ["k"]).collect()}
    for k, own in groups.items():
        ring = [(p["x"], p["y"]) for p in got[k]["ring"]]
        assert ring[0] == ring[-1] and set(ring) == (told_hull(own) or set(own))
        assert got[k]["area"] == pytest.approx(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2) and got[k]["area"] >= 0


def told_distances(cells, reach):
    own = np.array(sorted(cells))
    low, high = own.min(axis=0) - reach, own.max(axis=0) + reach
    out = {}
    for x in range(low[0], high[0] + 1):
        for y in range(low[1], high[1] + 1):
            d2 = int(((own - (x, y)) ** 2).sum(axis=1).min())
            if 0 < d2 <= reach * reach:
                out[x, y] = d2
    return out


def test_distances_and_growth(spark):
    import math

    from geoloom.operators.form import distances, expandability, grown, reach_of

    rng = random.Random(6)
    groups = {1: {(x, y) for x in range(14) for y in range(9)}, 2: {(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(70)}, 3: {(50, 50)}, 4: {(x, 0) for x in range(40)}, 5: {(0, y) for y in range(30)} | {(30, y) for y in range(25)}}
    df = spark.createDataFrame([(1, k, x, y) for k, own in groups.items() for x, y in own] + [(1, 3, 50, 50)], "city int, k int, cx long, cy long")
    n = {k: len(own) for k, own in groups.items()}
    reach = {k: math.ceil(math.sqrt(v) * (math.sqrt(2) - 1) / math.sqrt(math.pi)) + 2 for k, v in n.items()}
    got = {k: {} for k in groups}
    for r in distances(df, ["k"], reach_of(__import__("pyspark.sql.functions", fromlist=["x"]).col("n"))).collect():
        got[r["k"]][r["cx"], r["cy"]] = r["d2"]
    rings = {}
    for k, own in groups.items():
        far = told_distances(own, reach[k])
        assert got[k] == far
        edge = min(d for d in set(far.values()) if sum(v <= d for v in far.values()) >= n[k])
        rings[k] = {c for c, d in far.items() if d <= edge}
    found = {k: set() for k in groups}
    for r in grown(df, ["k"]).collect():
        found[r["k"]].add((r["cx"], r["cy"]))
    assert found == rings
    bare = {(x, y) for x in range(-5, 60) for y in range(-5, 60) if (x + 2 * y) % 3 == 0}
    row = expandability(df, spark.createDataFrame(sorted(bare), "cx long, cy long"), ["city"], ["k"]).collect()
    ring = set().union(*rings.values())
    assert [tuple(r) for r in row] == [(1, sum(n.values()), len(ring), len(ring - bare), len(ring - bare) / sum(n.values()))]


def test_coverage(spark):
    from geoloom.operators.form import coverage

    cells = [("a", x, y) for x in range(6) for y in range(6) if x in (0, 5) or y == 0] + [("b", 0, 0), ("b", 3, 3)]
    bare = [(x, 3) for x in range(-2, 9)]
    got = {r["k"]: tuple(r)[1:] for r in coverage(spark.createDataFrame(cells, "k string, cx long, cy long"), spark.createDataFrame(bare, "cx long, cy long"), ["k"], 2.0).collect()}
    assert got["a"] == (64.0, 144.0, 24.0, 64 / 120)
    assert got["b"] == (8.0, 28.0, 8.0, 0.4)  # of two centres one lies on the hull's left side, which counts
