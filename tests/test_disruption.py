"""Scenarios of broken edges against searching each network anew."""

from __future__ import annotations

import heapq
import random

import pytest

EDGES = "u int, v int, cost double, edge_id long"


def costs(edges, source):
    moves, out, heap = {}, {}, [(0.0, source)]
    for u, v, c, _ in edges:
        moves.setdefault(u, []).append((v, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in out:
            out[node] = cost
            for to, step in moves.get(node, ()):
                heapq.heappush(heap, (cost + step, to))
    return out


def network(rng, n=40, m=110):
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 30)), k) for k in range(m)]
    return edges + [(v, u, c, k) for u, v, c, k in edges[:70]] + [(edges[3][0], edges[3][1], 2.0, 500)]


def test_repaired_trees_equal_new_ones():
    from geoloom.operators.disruption import PathTree

    for seed in range(30):
        rng = random.Random(seed)
        edges = network(rng)
        out, into = {}, {}
        for u, v, c, e in edges:
            out.setdefault(u, []).append((v, c, e))
            into.setdefault(v, []).append((u, c, e))
        tree, gone, touched = PathTree(out, into, 0), set(), 0
        for _ in range(12):
            new = rng.sample(range(110), 6)
            gone |= set(new)
            touched += len(tree.close([(u, v, e) for u, v, _, e in edges if e in new], gone.__contains__))
            assert tree.cost == costs([x for x in edges if x[3] not in gone], 0)
        assert touched < 12 * 40


@pytest.mark.parametrize("how", [{}, {"block": 300}, {"heap_edges": 10}])
def test_scenarios_equal_whole_searches(spark, how):
    from geoloom.operators.disruption import draw_order, scenario_costs

    rng = random.Random(4)
    edges = network(rng)
    df = spark.createDataFrame(edges, EDGES)
    ends = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "d int")
    starts = spark.createDataFrame([(k,) for k in range(0, 40, 7)], "o int")
    key = lambda e, d: (e + 1) * (d * 7919 + 104729) * 48271 % 2147483647
    base, changed = scenario_costs(df, starts, ends, [10, 2.5, 40], 4, key, **how)
    ranks = {(r["draw"], r["edge_id"]): r["rank"] for r in draw_order(df, 4, key).collect()}
    ids = sorted({e for *_, e in edges})
    for d in range(4):
        assert [ranks[d, e] for e in sorted(ids, key=lambda e: (key(e, d), e))] == list(range(len(ids)))
    was = {o: costs(edges, o) for o in range(0, 40, 7)}
    assert {(r["o"], r["d"], r["base"]) for r in base.collect()} == {(o, d, c) for o, own in was.items() for d, c in own.items() if d % 3 == 0 and d != o}
    told = set()
    for p in (2.5, 10.0, 40.0):
        for draw in range(4):
            left = [x for x in edges if ranks[draw, x[3]] >= int(len(ids) * p / 100)]
            for o, own in was.items():
                now = costs(left, o)
                told |= {(p, draw, o, d, c, now.get(d)) for d, c in own.items() if d % 3 == 0 and d != o and now.get(d) != c}
    assert {tuple(r) for r in changed.collect()} == told


def test_shares_and_losses_by_hand(spark):
    from geoloom.operators.disruption import WORK_SECONDS, monte_carlo

    # Two ways from 1 to 2; edge 7 is the shorter, edge 9 the only way to 3; edge 11 is out of anybody's way.
    edges = spark.createDataFrame([(1, 2, 10.0, 7), (1, 4, 8.0, 8), (4, 2, 8.0, 8), (2, 3, 5.0, 9), (5, 6, 1.0, 11)], EDGES)
    demand = spark.createDataFrame([(1, 2, 2.0), (1, 3, 3.0), (2, 3, 5.0), (3, 1, 100.0), (1, 1, 9.0)], "o int, d int, flow double")
    first = lambda *ids: lambda e, d: __import__("pyspark.sql.functions", fromlist=["x"]).when(e.isin(*ids), 0).otherwise(1)
    row = monte_carlo(edges, demand, [25], 1, WORK_SECONDS * 0.01, key=first(7)).first()
    assert (row["isolated"], row["slowed"]) == (0.0, 0.5)
    assert row["delay"] == pytest.approx((2 * 6 + 3 * 6) / 10)
    loss = sum(0.06 * (f - 0.06 / 0.15) + 0.06 * (0.06 / 0.15) / 2 for f in (2, 3))
    assert row["loss_15"] == pytest.approx(loss)
    assert row["lost_share_15"] == pytest.approx(loss / (0.15 * (4 + 9 + 25) / 2))
    row = monte_carlo(edges, demand, [25], 1, WORK_SECONDS * 0.01, key=first(9)).first()
    assert (row["isolated"], row["delay"], row["slowed"]) == (0.8, 0.0, 0.0)
    assert row["lost_share_36"] == pytest.approx((9 + 25) / (4 + 9 + 25))
    row = monte_carlo(edges, demand, [0, 100], 1, 1.0).orderBy("percent").collect()
    assert tuple(row[0])[2:] == (0.0,) * 7
    assert (row[1]["isolated"], row[1]["delay"], row[1]["lost_share_15"]) == (1.0, None, 1.0)
