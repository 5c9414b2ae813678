"""Bounds and existing sites of the p-median against all choices."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

OD = "o int, d int, cost double, w_o double"


def table(rng, n=14, m=9, missing=0.0):
    place = lambda k: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(k)]
    a, b = place(n), place(m)
    w = [float(rng.randint(1, 9)) for _ in a]
    return [(i, j, ((x - u) ** 2 + (y - v) ** 2) ** 0.5, w[i]) for i, (x, y) in enumerate(a) for j, (u, v) in enumerate(b) if rng.random() >= missing]


def told(rows, p, forced=()):
    sites, origins = {d for _, d, _, _ in rows}, {o for o, *_ in rows}
    prices = {}
    for own in combinations(sorted(sites), p):
        if set(forced) <= set(own):
            best = {}
            for o, d, c, w in rows:
                if d in own:
                    best[o] = min(c * w, best.get(o, 1e18))
            prices[own] = (-len(best), sum(best.values()))
    return min(prices.items(), key=lambda x: (x[1][0], round(x[1][1], 9), x[0])), len(origins)


@pytest.mark.parametrize(("seed", "p", "forced"), [(1, 3, ()), (2, 4, (5, 0)), (3, 1, ())])
def test_bounds_hold_the_optimum(spark, seed, p, forced):
    from geoloom.operators.locate import p_median, p_median_bound

    rows = table(random.Random(seed))
    df = spark.createDataFrame(rows, OD)
    (sites, (_, cost)), _ = told(rows, p, forced)
    row = p_median_bound(df, p, 40, forced).first()
    assert row["lower"] <= cost + 1e-6 and row["upper"] >= cost - 1e-6
    assert row["gap"] < 0.05 and set(forced) <= set(row["sites"]) and len(row["sites"]) == p
    assert [r["d"] for r in p_median(df, p, forced=forced).collect()] == list(sites)


def test_exchange_keeps_existing_sites(spark):
    from geoloom.operators.locate import p_median

    rows = table(random.Random(6), missing=0.3)
    df = spark.createDataFrame(rows, OD)
    got = [r["d"] for r in p_median(df, 4, method="exchange", forced=[7]).collect()]
    assert 7 in got and len(got) == 4
    with pytest.raises(ValueError):
        p_median(df, 1, forced=[1, 2])


def test_bounds_without_any_table(spark):
    from geoloom.operators.locate import p_median_bound

    assert tuple(p_median_bound(spark.createDataFrame([], OD), 2).first()) == (None, None, None, [])
