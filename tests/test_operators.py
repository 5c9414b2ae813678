"""Operators without a SQL form, against brute force on small inputs."""

from __future__ import annotations

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, weights
from geoloom.operators import access, graph, locate, raster, routing, spatial
from geoloom.operators.components import connected_components


def dijkstra(edges, source):
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in dist:
            continue
        dist[x] = d
        for u, v, c in edges:
            if u == x and v not in dist:
                heapq.heappush(heap, (d + c, v))
    return dist


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(1, 40))) for _ in range(70)]
    return rows, spark.createDataFrame(rows, "u long, v long, cost double")


@pytest.mark.parametrize("heap_edges", [0, 1000])
def test_shortest_paths_match_dijkstra(spark, net, heap_edges):
    rows, edges = net
    found = routing.shortest_paths(edges, spark.createDataFrame([(i,) for i in range(6)], "o long"), heap_edges=heap_edges)
    got = {(r["o"], r["node"]): r["cost"] for r in found.collect()}
    assert got == {(o, n): c for o in range(6) for n, c in dijkstra([e for e in rows if e[0] != e[1]], o).items()}


def test_cutoff_keeps_near_nodes_only(spark, net):
    rows, edges = net
    found = routing.shortest_paths(edges, spark.createDataFrame([(0,)], "o long"), cutoff=30.0)
    assert {r["node"] for r in found.collect()} == {n for n, c in dijkstra(rows, 0).items() if c <= 30}


def test_flows_sum_to_hops(spark, net):
    _, edges = net
    paths = routing.shortest_paths(edges, spark.createDataFrame([(i,) for i in range(4)], "o long"))
    demand = paths.filter("hops > 0").select("o", F.col("node").alias("d"), F.lit(1.0).alias("flow"))
    total = routing.assign_flows(paths, demand).agg(F.sum("flow")).first()[0]
    assert total == paths.agg(F.sum("hops")).first()[0]


def test_broken_edges_match_a_search_without_them(spark, net):
    rows, edges = net
    ends = spark.createDataFrame([(i,) for i in range(4)], "o long")
    tested = edges.select("u", "v").distinct().orderBy("u", "v").limit(12)
    got = routing.break_edges(edges, tested, ends, ends.withColumnRenamed("o", "d")).collect()
    for r in got:
        left = [e for e in rows if (e[0], e[1]) != (r["edge_u"], r["edge_v"])]
        assert r["cost"] == dijkstra(left, r["o"]).get(r["d"])
        assert r["base"] == dijkstra(rows, r["o"])[r["d"]]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_join_is_exact(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(99, 900.0, -500.0)]
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    frame = lambda x: spark.createDataFrame(x, "id long, x double, y double")
    got = {(r["a_id"], r["rank"]): r["b_id"] for r in spatial.nearest_join(frame(a), frame(b), 3.0, 3).collect()}
    for i, x, y in a:
        order = sorted(b, key=lambda p: (((p[1] - x) ** 2 + (p[2] - y) ** 2) ** 0.5, p[0]))
        assert [got[i, k] for k in (1, 2, 3)] == [p[0] for p in order[:3]]


def test_nearest_join_of_nothing(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert spatial.nearest_join(some, none, 1.0).count() == 0
    assert spatial.nearest_join(none, some, 1.0).count() == 0


def test_furness_balances(spark):
    cells = [(o, d, 1.0 + o + d, 10.0 * (o + 1), 15.0 * (d + 1)) for o in range(3) for d in range(2) if True]
    total = sum(10.0 * (o + 1) for o in range(3))
    scale = total / sum(15.0 * (d + 1) for d in range(2))
    df = spark.createDataFrame([(o, d, w, p, a * scale) for o, d, w, p, a in cells], "o int, d int, weight double, production double, attraction double")
    out = access.furness(df, rounds=30, least=0.0).groupBy("o").agg(F.sum("flow").alias("s")).collect()
    assert {r["o"]: round(r["s"], 3) for r in out} == {o: 10.0 * (o + 1) for o in range(3)}


def test_market_access_by_hand(spark):
    times = [(0, 0, 5.0), (1, 0, 490.0), (2, 0, 15.0), (3, 0, 22.0), (0, 1, 2.0), (1, 1, 4.0), (2, 1, 6.0), (3, 1, 43.0), (0, 2, 500.0), (1, 2, 12.0), (2, 2, 16.0), (3, 2, 98.0)]
    od = spark.createDataFrame([(o, d, t, (2.0, 4.0, 1.0)[d]) for o, d, t in times], "o int, d int, cost double, w_d double")
    got = {r["o"]: r["access"] for r in access.market_access(od, 480).collect()}
    assert got[0] == pytest.approx(2.4) and got[1] == pytest.approx(1.08333, abs=1e-5)


def test_p_median_is_optimal_on_a_small_case(spark):
    rng = random.Random(9)
    rows = [(o, d, rng.uniform(1, 30), float(1 + o % 4)) for o in range(10) for d in range(7)]
    cost = {(o, d): c * w for o, d, c, w in rows}
    value = lambda sites: sum(min(cost[o, d] for d in sites) for o in range(10))
    od = spark.createDataFrame(rows, "o int, d int, cost double, w_o double")
    least = min(value(s) for s in itertools.combinations(range(7), 3))
    assert value([r["d"] for r in locate.p_median(od, 3).collect()]) == pytest.approx(least)
    assert value([r["d"] for r in locate.p_median(od, 3, most_choices=0).collect()]) <= 1.15 * least


def test_p_median_serves_most_origins_in_both_branches(spark):
    rng = random.Random(3)
    rows = [(o, d, 1.0 + rng.random() * 20, 1.0 + o % 3) for o in range(18) for d in range(8) if (o * 5 + d * 3) % 7 < 3]
    rows.append((99, 8, 0.0, 1.0))  # a site that only its own place reaches, at no cost
    cost = {(o, d): c * w for o, d, c, w in rows}

    def value(sites):
        best = [min(own) for o in {r[0] for r in rows} if (own := [cost[o, d] for d in sites if (o, d) in cost])]
        return -len(best), sum(best)

    od = spark.createDataFrame(rows, "o int, d int, cost double, w_o double")
    served, least = min(value(s) for s in itertools.combinations(range(9), 3))
    exact, swapped = (value([r["d"] for r in locate.p_median(od, 3, most_choices=k).collect()]) for k in (5_000, 0))
    assert exact == (served, pytest.approx(least))
    assert swapped[0] == served and swapped[1] <= 1.15 * least


def test_cover_reaches_its_share(spark):
    rows = [(o, d, float(abs(o - 4 * d)), 1.0) for o in range(20) for d in range(5)]
    od = spark.createDataFrame(rows, "o int, d int, cost double, w_o double")
    assert locate.max_cover(od, 2, 2.0).agg(F.sum("gained")).first()[0] == 10
    assert locate.set_cover(od, 2.0).agg(F.sum("gained")).first()[0] == len({o for o, _, c, _ in rows if c <= 2})


def test_graph_cleaning(spark):
    e = spark.createDataFrame([(1, 2, 10.0), (2, 1, 12.0), (1, 2, 40.0), (3, 4, 5.0)], "u long, v long, length double")
    assert graph.drop_clones(e).count() == 3
    assert graph.simple_graph(e).filter("u = 1").first()["length"] == 40
    assert graph.reflect_missing(e).filter("u = 4").count() == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "u long, v long")
    assert {r["node"] for r in graph.interior_nodes(chain).collect()} == {1, 2, 3}
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9, 3, 8])], "way_id long, nds array<long>")
    assert sorted((r["way_id"], r["nds"]) for r in graph.split_ways(ways).collect()) == [(1, [1, 2, 3]), (1, [3, 4]), (2, [3, 8]), (2, [9, 3])]
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "node long, x double, y double")
    assert graph.way_segments(ways, nodes).count() == 10
    assert graph.disrupt_random(e.withColumn("cost", F.lit(1.0)), 50.0, 3, 9.0, "length").count() == 4


def test_geometry(spark):
    line = "LINESTRING (0 0, 0 3, 4 3, 0 0)"
    df = spark.createDataFrame([(line, "(1.5, -2)")], "w string, p string").withColumn("pts", geo.line_points(F.col("w")))
    x, y = geo.parse_pair(F.col("p"))
    row = df.select(geo.ring_area(F.col("pts")).alias("a"), x.alias("x"), y.alias("y"), geo.point_in_ring(F.lit(1.0), F.lit(2.0), F.col("pts")).alias("i"), geo.bearing_degrees(F.lit(-1.0), F.lit(0.0)).alias("b"), weights.round_significant(F.lit(0.0347)).alias("r"), geo.utm_epsg(F.lit(2.1), F.lit(13.5)).alias("utm")).first()
    assert (row["a"], row["x"], row["y"], row["i"], row["b"], round(row["r"], 6), row["utm"]) == (-6.0, 1.5, -2.0, True, 270.0, 0.03, 32631)


def test_clusters_follow_neighbours(spark):
    cells = [(0, 0, 5.0), (1, 1, 5.0), (5, 5, 9.0), (6, 6, 0.5), (-3, 2, 2.0)]
    out = raster.clusters(spark.createDataFrame(cells, "cx long, cy long, value double"), 1.0, 5.0)
    assert sorted((r["cx"], r["cy"], r["total"]) for r in out.collect()) == [(0, 0, 10.0), (1, 1, 10.0), (5, 5, 9.0)]


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    from geoloom.streaming.events import counts_by_window

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").select("window_start", "event_type", "n").exceptAll(counts_by_window(events).select("window_start", "event_type", "n")).count() == 0


def test_chains_are_drawn_together(spark):
    rows = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 4.0), (4, 5, 8.0), (4, 6, 1.0), (10, 11, 1.0), (11, 12, 1.0), (12, 10, 1.0), (6, 7, 1.0), (7, 8, 1.0), (8, 6, 5.0), (6, 9, 1.0)]
    out = sorted((r["u"], r["v"], r["length"], r["parts"]) for r in graph.contract_chains(spark.createDataFrame(rows, "u long, v long, length double")).collect())
    assert out == sorted([(1, 4, 7.0, 3), (4, 5, 8.0, 1), (4, 6, 1.0, 1), (10, 11, 1.0, 1), (11, 12, 1.0, 1), (12, 10, 1.0, 1), (6, 6, 7.0, 3), (6, 9, 1.0, 1)])


def test_close_nodes_merge_and_networks_join(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 5.0, 5.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 7.0)], "u long, v long, length double")
    n, e = graph.merge_close_nodes(nodes, edges, 1.0)
    assert sorted((r["node"], r["x"]) for r in n.collect()) == [(1, 0.25), (3, 5.0)]
    assert [(r["u"], r["v"]) for r in e.collect()] == [(1, 3)]
    other = spark.createDataFrame([(1, 5.0, 5.5), (2, 90.0, 90.0)], "node long, x double, y double")
    glued = graph.join_networks(nodes, edges, other, edges.limit(0), 1.0, 2.0).filter("kind = 'glue'").collect()
    assert sorted((r["u"], r["v"], r["length"]) for r in glued) == [("3", "add_1", 0.5), ("add_1", "3", 0.5)]


def test_travel_cost_over_a_surface(spark):
    cells = [(x, y, 1.0 if x != 1 or y == 2 else 50.0) for x in range(3) for y in range(3)]
    edges = raster.cost_edges(spark.createDataFrame(cells, "cx long, cy long, value double"))
    cost = {r["node"]: r["cost"] for r in routing.shortest_paths(edges, spark.createDataFrame([("0:0",)], "o string")).collect()}
    assert cost["2:0"] == pytest.approx(2 + 2 * 2**0.5) and len(cost) == 9


def test_expansion_and_first_return(spark):
    old = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "cx long, cy long")
    new = spark.createDataFrame([(1, 1, 1), (2, 9, 9)], "patch int, cx long, cy long")
    assert {r["patch"]: (r["ring"], r["lei"]) for r in raster.expansion_index(old, new).collect()} == {1: (8, 37.5), 2: (8, 0.0)}
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 120.0), (3.0, 5.0)], "y5 double, y50 double")
    assert [r["first_return"] for r in raster.first_return(df, [50, 5]).collect()] == [50, 0, 5]


def test_segments_cross_once(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 10.0, 10.0, 0.0), (3, 20.0, 0.0, 30.0, 0.0), (4, 0.0, 1.0, 10.0, 11.0)]
    out = spatial.segment_crossings(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double"), 3.0).collect()
    assert sorted((r["a_id"], r["b_id"], round(r["x"], 6), round(r["y"], 6)) for r in out) == [(1, 2, 5.0, 5.0), (2, 4, 4.5, 5.5)]


def rows_by_label(monkeypatch, module):
    """Counts the rows that a module materialises, by label; the most of each."""
    rows, keep = {}, module.materialize

    def counted(df, label="part"):
        out = keep(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(module, "materialize", counted)
    return rows


def test_nearest_join_searches_places(spark, monkeypatch):
    """Points that share a place are searched for once, and each gets the same neighbours."""
    rows = rows_by_label(monkeypatch, spatial)
    a = spark.range(300).selectExpr("id", "double(id % 3) as x", "0.0D as y").unionByName(spark.createDataFrame([(999, None, 1.0)], "id long, x double, y double"))
    b = spark.range(200).selectExpr("id", "double(id % 2) * 5 as x", "0.0D as y").unionByName(spark.createDataFrame([(999, 1.0, None)], "id long, x double, y double"))
    got = {(r["a_id"], r["rank"]): (r["b_id"], r["dist"]) for r in spatial.nearest_join(a, b, 1.0, 1).collect()}
    assert got == {(k, 1): (0, float(k % 3)) for k in range(300) if k % 3 < 3}
    assert rows["near"] <= 3 and rows["targets"] == 2


def test_nearest_join_ranks_copies_by_id(spark):
    """More copies in the nearest place than are asked for: the smallest ids; fewer: the next place fills up."""
    a = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.0), (9, 10.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(k, 1.0, 0.0) for k in (5, 3, 4, 2)] + [(1, 9.0, 0.0)], "id long, x double, y double")
    got = {(r["a_id"], r["rank"]): r["b_id"] for r in spatial.nearest_join(a, b, 1.0, 3).collect()}
    assert got == {(7, 1): 2, (7, 2): 3, (7, 3): 4, (8, 1): 2, (8, 2): 3, (8, 3): 4, (9, 1): 1, (9, 2): 2, (9, 3): 3}


def test_a_cut_line_is_worked_out_once(spark):
    """The parts of parts of a line are told by expressions whose size adds up; it does not multiply."""
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    line = F.array(at(0.0, 0.0), (at(4.0, 0.0)), F.struct(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("y")))
    one = geo.cut_line(line, 1.0)[1]
    three = geo.cut_line(geo.cut_line(one, 1.0)[1], 1.0)[1]
    long = lambda c: len(spark.range(4, 5).select(c.alias("c"))._jdf.queryExecution().analyzed().toString())
    assert long(three) < 12 * long(one)
    assert [tuple(p) for p in spark.range(4, 5).select(three.alias("c")).first()["c"]] == [(3.0, 0.0), (4.0, 0.0), (4.0, 3.0)]


@pytest.mark.parametrize(("n", "wide", "grid"), [(300, 12.0, None), (300, 4.0, None), (500, 40.0, 0.5), (40, 0.0, None)])
def test_close_groups_equal_brute_force(spark, n, wide, grid):
    """Sparse, crowded, on a lattice (distances of exactly the radius) and all in one place; some points have no place."""
    from geoloom.operators.spatial import close_groups

    rng = random.Random(n)
    spot = lambda: rng.uniform(-wide, wide) if grid is None else round(rng.uniform(-wide, wide) / 8) * grid
    points = [(k, spot(), spot()) for k in range(n)]
    odd = [(n, None, 1.0), (n + 1, float("nan"), 1.0), (n + 2, float("inf"), 0.0), (n + 3, None, None)]
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x, y in points:
        for j, a, b in points[:i]:
            if math.sqrt((x - a) ** 2 + (y - b) ** 2) <= 0.5 and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    df = spark.createDataFrame(points + odd, "id long, x double, y double")
    got = {r["id"]: r["group"] for r in close_groups(df, 0.5).collect()}
    assert got == {k: top(k) for k in range(n)} | {k: k for k, _, _ in odd}
    assert {r["id"]: r["group"] for r in close_groups(df, 0.0).collect()} == {k: k for k, _, _ in points + odd}


def test_crowded_nodes_merge_without_a_list_of_pairs(spark, monkeypatch):
    """Eight hundred nodes within the radius of each other make 319,600 pairs; none of them is written."""
    from geoloom.operators import components, graph, spatial
    from geoloom.plans import materialize as m

    rows = []

    def counted(df, label="part"):
        out = m.materialize(df, label)
        rows.append(out.count())
        return out

    for module in (components, graph, spatial):
        monkeypatch.setattr(module, "materialize", counted)
    rng = random.Random(3)
    nodes = [(f"n{k:03}", rng.uniform(0.0, 0.6), rng.uniform(0.0, 0.6)) for k in range(800)] + [("z", 9.0, 9.0)]
    edges = spark.createDataFrame([("n000", "n700", 1.0), ("n300", "z", 2.0)], "u string, v string, length double")
    placed, moved = graph.merge_close_nodes(spark.createDataFrame(nodes, "node string, x double, y double"), edges, 1.0)
    assert [tuple(r) for r in moved.select("u", "v", "length").collect()] == [("n000", "z", 2.0)]
    assert {r["node"]: round(r["x"], 9) for r in placed.collect()} == {"n000": round(sum(n[1] for n in nodes[:800]) / 800, 9), "z": 9.0}
    assert max(rows) <= len(nodes)
