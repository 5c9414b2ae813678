"""K cheapest loopless paths against listing all of them."""

from __future__ import annotations

import random

import pytest


def told(edges, o, d, k):
    moves = {}
    for u, v, c in edges:
        if u != v:
            moves.setdefault(u, {})
            moves[u][v] = min(c, moves[u].get(v, c))
    out, stack = [], [(0.0, [o])]
    while stack:
        cost, path = stack.pop()
        if path[-1] == d:
            out.append((cost, len(path), path))
            continue
        stack += [(cost + c, [*path, v]) for v, c in moves.get(path[-1], {}).items() if v not in path]
    return [(c, p) for c, _, p in sorted(out)[:k]]


def test_deviations_equal_all_paths():
    from geoloom.operators.routing import _deviations, _search

    for seed in range(40):
        rng = random.Random(seed)
        edges = [(rng.randrange(9), rng.randrange(9), float(rng.randint(1, 4))) for _ in range(26)]
        least = {}
        for u, v, c in edges:
            if u != v:
                least[u, v] = min(c, least.get((u, v), c))
        out, into = {}, {}
        for (u, v), c in least.items():
            out.setdefault(u, []).append((v, c))
            into.setdefault(v, []).append((u, c))
        for d in range(9):
            back = {node: cost for node, cost, _, _ in _search(into, d, None)}
            for o in range(9):
                if o != d:
                    assert _deviations(out, back, o, d, 6) == told(edges, o, d, 6), (seed, o, d)


@pytest.mark.parametrize("heap_edges", [500_000, 3])
def test_paths_of_all_pairs(spark, heap_edges):
    from geoloom.operators.routing import k_paths

    rng = random.Random(3)
    edges = [(rng.randrange(8), rng.randrange(8), float(rng.randint(1, 9))) for _ in range(20)]
    ends = [(o, d) for o in range(9) for d in range(8)]
    got = k_paths(spark.createDataFrame(edges, "u int, v int, cost double"), spark.createDataFrame(ends, "o int, d int"), 4, heap_edges).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r["o"], r["d"]), []).append((r["cost"], r["path"]))
    assert found == {(o, d): t for o, d in ends if o != d and (t := told(edges, o, d, 4))}
