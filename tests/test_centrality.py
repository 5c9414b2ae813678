"""Betweenness and the like against listing all shortest paths."""

from __future__ import annotations

import random

import pytest


def told(edges):
    moves, nodes = {}, sorted({x for e in edges for x in e[:2]})
    for u, v, c in edges:
        if u != v:
            moves.setdefault(u, {})[v] = min(c, moves.get(u, {}).get(v, c))
    every = {}
    for o in nodes:
        stack = [(0.0, [o])]
        while stack:
            cost, path = stack.pop()
            if len(path) > 1:
                every.setdefault((o, path[-1]), []).append((cost, path))
            stack += [(cost + c, [*path, v]) for v, c in moves.get(path[-1], {}).items() if v not in path]
    by_node, by_edge, costs = {}, {}, {}
    for (o, d), found in every.items():
        least = min(c for c, _ in found)
        costs[o, d] = least
        best = [p for c, p in found if c == least]
        for p in best:
            for x in p[1:-1]:
                by_node[x] = by_node.get(x, 0) + 1 / len(best)
            for e in zip(p, p[1:]):
                by_edge[e] = by_edge.get(e, 0) + 1 / len(best)
    return by_node, by_edge, costs


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_counts_equal_paths(spark, seed):
    from geoloom.operators.centrality import betweenness, closeness, network_figures
    from geoloom.operators.routing import shortest_paths

    rng = random.Random(seed)
    edges = [(rng.randrange(8), rng.randrange(8), float(rng.randint(1, 3))) for _ in range(22)] + [(20, 21, 1.0)]
    df = spark.createDataFrame(edges, "u int, v int, cost double")
    nodes, ways, costs = told(edges)
    got_nodes, got_edges = betweenness(df)
    assert {r["node"]: pytest.approx(r["betweenness"]) for r in got_nodes.collect()} == nodes
    assert {(r["u"], r["v"]): pytest.approx(r["betweenness"]) for r in got_edges.collect()} == ways
    paths = shortest_paths(df, df.selectExpr("u as o").union(df.selectExpr("v")))
    every = {x for e in edges for x in e[:2]}
    for r in closeness(paths).collect():
        own = [c for (o, _), c in costs.items() if o == r["node"]]
        assert (r["reached"], r["farthest"]) == (len(own), max(own))
        assert r["closeness"] == pytest.approx(len(own) / sum(own) * len(own) / (len(every) - 1))
    row = network_figures(df).first()
    flat = {tuple(sorted(e[:2])) for e in edges if e[0] != e[1]}
    linked = {x for e in flat for x in e}
    parts = []
    for e in flat:
        met = [p for p in parts if p & set(e)]
        parts = [p for p in parts if p not in met] + [set(e).union(*met)]
    assert (row["nodes"], row["edges"], row["parts"], row["cycles"]) == (len(linked), len(flat), len(parts), len(flat) - len(linked) + len(parts))
    assert (row["reached_pairs"], row["diameter"]) == (len(costs), max(costs.values()))
    assert row["mean_cost"] == pytest.approx(sum(costs.values()) / len(costs)) and -1 <= row["assortativity"] <= 1
