"""Strong components against reachability, with and without the one-task end."""

from __future__ import annotations

import random

import pytest


def told(edges):
    ahead = {}
    for u, v in edges:
        if u is not None and v is not None:
            ahead.setdefault(u, set()).add(v)
    nodes = {x for e in edges for x in e if x is not None}

    def reach(a):
        seen, front = {a}, [a]
        while front:
            front = [y for x in front for y in ahead.get(x, ()) if y not in seen and not seen.add(y)]
        return seen

    far = {a: reach(a) for a in nodes}
    return {a: min(b for b in far[a] if a in far[b]) for a in nodes}


def graph(rng, n, m):
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    at = n
    for _ in range(6):  # chains and rings that hang on it, or not
        ends = [rng.randrange(n)] + list(range(at, at + rng.randint(1, 9))) + [rng.choice([rng.randrange(n), at])]
        at += 10
        edges += list(zip(ends, ends[1:]))
    return edges + [(at + k, at + (k + 1) % 5) for k in range(5)] + [(at + 9, at + 9), (None, 1), (2, None)]


@pytest.mark.parametrize(("seed", "n", "m", "few"), [(1, 60, 90, 500_000), (2, 60, 70, 0), (3, 30, 120, 0), (4, 80, 75, 25), (5, 12, 0, 0)])
def test_components_equal_reachability(spark, seed, n, m, few):
    from geoloom.operators.components import strong_components

    edges = graph(random.Random(seed), n, m)
    got = strong_components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()
    assert {r["node"]: r["component"] for r in got} == told(edges) and len(got) == len(told(edges))


@pytest.mark.parametrize("ring", [False, True])
def test_a_long_one_way_road_takes_few_rounds(spark, ring):
    from geoloom.operators import components

    n = 5_000
    rounds, plain = [], components.materialize
    components.materialize = lambda df, label="part": (rounds.append(label), plain(df, label))[1]
    try:
        edges = spark.range(n if ring else n - 1).selectExpr("(id * 7) % 5000 as u", f"((id + 1) % {n} * 7) % 5000 as v")
        got = components.strong_components(edges, few=0).selectExpr("count(*) as n", "count(distinct component) as parts").first()
    finally:
        components.materialize = plain
    assert tuple(got) == (n, 1 if ring else n)
    assert len(rounds) < 60


def test_labels_of_deep_graphs():
    from geoloom.operators.components import strong_labels

    n = 200_000
    assert len(set(strong_labels([[(i + 1) % n] for i in range(n)]))) == 1
    assert len(set(strong_labels([[i + 1] if i + 1 < n else [] for i in range(n)]))) == n
    assert strong_labels([]) == []


def test_no_edges(spark):
    from geoloom.operators.components import strong_components

    assert strong_components(spark.createDataFrame([], "u long, v long")).collect() == []
