"""Coverings, noding and outlines against brute force."""

from __future__ import annotations

import math
import random

import pytest


def star(rng, x, y, corners, low, high):
    at = [(2 * math.pi * (k + rng.random() * 0.8) / corners, rng.uniform(low, high)) for k in range(corners)]
    ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in at]
    return [*ring, ring[0]]


def inside(x, y, rings):
    odd = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd += 1
    return odd % 2 == 1


RINGS = "poly_id int, rings array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize(("size", "budget"), [(0.5, 64), (3.0, 1_024), (100.0, 16)])
def test_points_in_any_polygons(spark, size, budget):
    from geoloom.operators.polygons import points_in_polygons

    rng = random.Random(3)
    polygons = [(k, [star(rng, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.randint(3, 40), 1, 40)]) for k in range(8)]
    polygons.append((8, [star(rng, 0, 0, 30, 30, 60), star(rng, 0, 0, 12, 5, 20), star(rng, 70, 70, 9, 3, 9)]))  # a hole and a second part
    polygons.append((9, [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 4.0), (0.0, 8.0), (0.0, 0.0)]]))  # corners on cell borders
    polygons.append((10, [[(5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]]))  # no area
    points = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(1_500)]
    points += [(2_000 + 100 * i + j, float(i), float(j)) for i in range(-1, 10) for j in range(-1, 10)] + [(9_999, None, 1.0)]
    got = points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(polygons, RINGS), size, budget)
    told = [(i, k) for i, x, y in points if x is not None for k, rings in polygons if inside(x, y, rings)]
    assert sorted((r["id"], r["poly_id"]) for r in got.collect()) == sorted(told)


def test_a_country_on_fine_cells_has_bounded_rows(spark):
    from geoloom.operators.polygons import covering, levels_of, most_rows

    rng = random.Random(1)
    ring = star(rng, 0, 0, 5_000, 400_000, 600_000)
    df = spark.createDataFrame([(1, [ring])], RINGS)
    for budget in (64, 512):
        rows = covering(df, 1.0, budget).select("level", "cx", "cy", "legs").collect()
        assert len(rows) <= most_rows(budget, levels_of(1.0, 1_300_000))  # its bounding box has about 10^12 cells
        border = [r for r in rows if r["legs"] is not None]
        assert len(border) <= budget
    area = sum(4.0 ** r["level"] for r in rows if r["legs"] is None)
    whole = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    assert area <= whole <= sum(4.0 ** r["level"] for r in rows)


def test_dissolve_and_overlay_equal_brute_force(spark):
    from geoloom.operators.graph import dissolve
    from geoloom.operators.polygons import touching_pairs

    rng = random.Random(8)
    a = [(k, [star(rng, rng.uniform(0, 60), rng.uniform(0, 60), 7, 2, 15)]) for k in range(12)]
    df = spark.createDataFrame(a, "id int, rings array<array<struct<x:double,y:double>>>").selectExpr("id", "id % 3 as kind", "rings")
    got = {tuple(r) for r in dissolve(df, "kind", 1.0).collect()}
    assert got == {(k % 3, i, j) for k, rings in a for i in range(-20, 80) for j in range(-20, 80) if inside(i + 0.5, j + 0.5, rings)}
    pairs = {tuple(r) for r in touching_pairs(df, df, 1.0, 2_048).collect()}
    cells = {k: {(i, j) for i in range(-20, 80) for j in range(-20, 80) if inside(i + 0.5, j + 0.5, rings)} for k, rings in a}
    assert {(i, j) for i in cells for j in cells if cells[i] & cells[j]} <= pairs
    boxes = {k: (min(x for x, _ in r[0]), max(x for x, _ in r[0]), min(y for _, y in r[0]), max(y for _, y in r[0])) for k, r in a}
    apart = {(i, j) for i, p in boxes.items() for j, q in boxes.items() if p[1] + 4 < q[0] or q[1] + 4 < p[0] or p[3] + 4 < q[2] or q[3] + 4 < p[2]}
    assert not pairs & apart


def cross(a, b, tiny=1e-9):
    """Whether two legs cross or touch inside both of them."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if abs(det) < 1e-12:
        return False
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    s = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    return tiny < t < 1 - tiny and tiny < s < 1 - tiny


LINES = "line_id int, points array<struct<x:double,y:double>>"


def test_noded_lines_cross_at_nodes_only(spark):
    from geoloom.operators.noding import node_lines

    rng = random.Random(2)
    lines = [(k, [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(rng.randint(2, 5))]) for k in range(25)]
    df = spark.createDataFrame(lines, LINES)
    nodes, edges = node_lines(df, 2.5, 1e-6)
    got = [r.asDict() for r in edges.collect()]
    at = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    pieces = [(p["x"], p["y"], q["x"], q["y"]) for r in got for p, q in zip(r["points"], r["points"][1:])]
    assert not any(cross(a, b, 1e-5) for i, a in enumerate(pieces) for b in pieces[:i])
    legs = [(k, i, *a, *b) for k, p in lines for i, (a, b) in enumerate(zip(p, p[1:]))]
    told = sum(1 for i, a in enumerate(legs) for b in legs[:i] if cross(a[2:], b[2:]) and not (a[0] == b[0] and abs(a[1] - b[1]) <= 1))
    assert len(at) == told + 2 * len(lines)
    assert len(got) == 2 * told + len(lines)  # every crossing adds one piece to each of both lines
    for k, p in lines:
        own = sorted((r for r in got if r["line_id"] == k), key=lambda r: r["seq"])
        assert sum(r["length"] for r in own) == pytest.approx(sum(math.dist(a, b) for a, b in zip(p, p[1:])))
        assert all(a["v"] == b["u"] for a, b in zip(own, own[1:]))  # in order along the line
        assert math.dist(at[own[0]["u"]], p[0]) < 1e-5 and math.dist(at[own[-1]["v"]], p[-1]) < 1e-5


def test_touching_overlapping_and_odd_lines(spark):
    from geoloom.operators.noding import node_lines

    lines = [
        (1, [(0.0, 0.0), (10.0, 0.0)]),
        (2, [(5.0, 0.0), (5.0, 5.0)]),  # ends on line 1
        (3, [(2.0, 3.0), (2.0, 0.0000004)]),  # ends within the grid of line 1
        (4, [(4.0, 0.0), (8.0, 0.0), (8.0, 4.0)]),  # runs along line 1, then leaves it
        (5, [(0.0, 8.0), (4.0, 8.0), (4.0, 10.0), (2.0, 10.0), (2.0, 7.0)]),  # crosses itself
        (6, [(1.0, 1.0), (1.0, 1.0)]),
        (7, [(1.0, 1.0)]),
        (8, None),
        (9, [(3.0, None), (20.0, 20.0), (21.0, 20.0)]),
        (10, [(30.0, 30.0), (31.0, 30.0), (31.0, 31.0), (30.0, 30.0)]),  # a ring by itself
    ]
    nodes, edges = node_lines(spark.createDataFrame(lines, LINES), 3.0, 1e-6)
    count = {}
    for r in edges.collect():
        count[r["line_id"]] = count.get(r["line_id"], 0) + 1
    assert count == {1: 5, 2: 1, 3: 1, 4: 3, 5: 3, 9: 1, 10: 1}
    assert nodes.filter("node = '5000000:0'").count() == 1
    none = spark.createDataFrame([], LINES)
    assert node_lines(none, 3.0, 1e-6)[1].collect() == []


def test_clean_roads_of_a_grid(spark):
    """A street grid with a doubled carriageway: its junctions alone stay."""
    from geoloom.operators.noding import road_network

    n = 6
    lines = [(k, [(0.0, 100.0 * k), (100.0 * (n - 1), 100.0 * k)]) for k in range(n)] + [(10 + k, [(100.0 * k, 0.0), (100.0 * k, 100.0 * (n - 1))]) for k in range(n)]
    lines.append((99, [(0.0, 302.0), (500.0, 302.0)]))  # the other carriageway of a street
    lines.append((98, [(500.0, 500.0), (550.0, 500.0), (600.0, 500.0), (600.0, 550.0)]))  # a spur of several legs
    nodes, edges, report = road_network(spark.createDataFrame(lines, LINES), 60.0, 0.001, 10.0)
    left = {r["step"]: r["edges"] for r in report.collect()}
    assert left["given"] == 2 * n * (n - 1) + (n - 1) + 6 + 1
    assert left["junctions merged"] == left["given"] - 6  # the short ends between both carriageways
    assert left["parallels dropped"] <= left["junctions merged"] - (n - 1)
    assert left["both directions"] == edges.count() == 2 * left["chains contracted again"]
    # Corners have two neighbours and are contracted, but the one with the spur, which ends the spur.
    assert nodes.count() == n * n - 3 + 1


def told_parts(cells, diagonal=False):
    """Cells of each contiguous part."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, parts = set(cells), []
    while left:
        front = {left.pop()}
        part = set(front)
        while front:
            front = {(x + a, y + b) for x, y in front for a, b in steps} & left
            left -= front
            part |= front
        parts.append(part)
    return parts


@pytest.mark.parametrize("diagonal", [False, True])
def test_outlines_hold_their_cells(spark, diagonal):
    from geoloom.operators.outlines import outlines

    rng = random.Random(7)
    groups = {"a": {(rng.randrange(14), rng.randrange(14)) for _ in range(110)}, "b": {(x, y) for x in range(-9, 10) for y in range(-9, 10) if max(abs(x), abs(y)) % 3 != 1}, "c": {(5, 5)}, None: {(0, 0), (1, 1), (1, 0)}}
    rows = [(k, x, y) for k, own in groups.items() for x, y in own]
    got = outlines(spark.createDataFrame(rows + rows[:30], "kind string, cx long, cy long"), ["kind"], 2.0, diagonal).collect()
    for kind, own in groups.items():
        told = sorted(sorted(p) for p in told_parts(own, diagonal))
        found = []
        for r in (r for r in got if r["kind"] == kind):
            rings = [[(p["x"] / 2, p["y"] / 2) for p in ring] for ring in r["rings"]]
            assert all(ring[0] == ring[-1] for ring in rings)
            assert all((a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) != (b[0] == c[0]) for ring in rings for a, b, c in zip(ring, ring[1:], ring[2:]))
            areas = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2 for ring in rings]
            assert areas[0] > 0 and all(a < 0 for a in areas[1:])
            assert r["n_corners"] == sum(len(ring) - 1 for ring in rings) and r["area"] == 4 * sum(areas)
            assert r["perimeter"] == 2 * sum(math.dist(a, b) for ring in rings for a, b in zip(ring, ring[1:]))
            found.append([(x, y) for x in range(-12, 16) for y in range(-12, 16) if inside(x + 0.5, y + 0.5, rings)])
        assert sorted(found) == told


def test_a_long_ring_takes_few_rounds(spark):
    from geoloom.operators import outlines
    from geoloom.plans import materialize as m

    rounds, plain = [], m.materialize
    outlines.materialize = lambda df, label="part": (rounds.append(label), plain(df, label))[1]
    try:
        links = spark.range(5_000).selectExpr("id as side", "(id + 1) % 5000 as next")
        got = outlines.ring_order(links).selectExpr("count(*)", "max(place)", "max(ring)", "sum(cast(place = side as int))").first()
    finally:
        outlines.materialize = plain
    assert tuple(got) == (5_000, 4_999, 0, 5_000)
    assert len(rounds) < 35


def area(rings):
    """Of rings that don't overlap but as holes, by the even-odd rule."""
    own = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2 for r in rings]
    return own[0] - sum(own[1:])


ANY = "id int, rings array<array<struct<x:double,y:double>>>"


def test_trapezoids_fill_their_polygons(spark):
    from geoloom.functions.geo import ring_area
    from geoloom.operators.polygons import trapezoids

    rng = random.Random(11)
    shapes = [(k, [star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.randint(3, 30), 2, 9)]) for k in range(10)]
    shapes.append((10, [star(rng, 0, 0, 24, 8, 14), star(rng, 0, 0, 9, 2, 7)]))
    shapes.append((11, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0), (0.0, 0.0)]]))
    shapes.append((12, [[(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]]))
    pieces = trapezoids(spark.createDataFrame(shapes, ANY)).withColumn("area", ring_area(__import__("pyspark.sql.functions", fromlist=["x"]).col("ring"))).collect()
    for k, rings in shapes:
        own = [r for r in pieces if r["id"] == k]
        assert sum(r["area"] for r in own) == pytest.approx(area(rings), abs=1e-9) and all(r["area"] > 0 for r in own)
        for _ in range(60):
            x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
            assert sum(inside(x, y, [[(p["x"], p["y"]) for p in r["ring"]]]) for r in own) == inside(x, y, rings)


def test_overlays_of_any_polygons(spark):
    from geoloom.operators.polygons import overlay

    rng = random.Random(12)
    a = [(k, [star(rng, rng.uniform(0, 30), rng.uniform(0, 30), rng.randint(3, 12), 2, 9)]) for k in range(8)] + [(8, [star(rng, 15, 15, 20, 12, 16), star(rng, 15, 15, 8, 3, 10)])]
    b = [(100 + 10 * i + j, [[(10.0 * i, 10.0 * j), (10.0 * i + 10, 10.0 * j), (10.0 * i + 10, 10.0 * j + 10), (10.0 * i + 4, 10.0 * j + 4), (10.0 * i, 10.0 * j + 10), (10.0 * i, 10.0 * j)]]) for i in range(3) for j in range(3)]
    rows = overlay(spark.createDataFrame(a, ANY), spark.createDataFrame(b, ANY), 2.0, "union").collect()
    got = {(r["a_id"], r["b_id"]): (r["area"], [[(p["x"], p["y"]) for p in ring] for ring in r["pieces"]]) for r in rows}
    assert len(got) == len(rows)
    common = overlay(spark.createDataFrame(a, ANY), spark.createDataFrame(b, ANY), 2.0).collect()
    assert {(r["a_id"], r["b_id"]) for r in common} == {k for k in got if None not in k}
    for k, rings in a:  # b's polygons don't overlap, so what they share with a polygon and its rest make it up
        assert sum(s for (i, _), (s, _) in got.items() if i == k) == pytest.approx(area(rings))
    for _ in range(1_500):
        x, y = rng.uniform(-12, 42), rng.uniform(-12, 42)
        in_a, in_b = {k for k, r in a if inside(x, y, r)}, {k for k, r in b if inside(x, y, r)}
        told = {(i, j) for i in in_a for j in in_b} | ({(i, None) for i in in_a} if not in_b else set()) | ({(None, j) for j in in_b} if not in_a else set())
        assert {k for k, (_, pieces) in got.items() if any(inside(x, y, [p]) for p in pieces)} == told
    assert overlay(spark.createDataFrame([], ANY), spark.createDataFrame(b, ANY), 2.0, "union").count() == len(b)


def test_equal_lines_are_cut_once(spark, monkeypatch):
    """Forty copies of each of two crossing lines: one crossing is looked for, and every copy gets its pieces."""
    from geoloom.operators import noding

    rows, keep = {}, noding.materialize

    def counted(df, label="part"):
        out = keep(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(noding, "materialize", counted)
    lines = [(k, [(0.0, 0.0), (4.0, 4.0)] if k % 2 else [(0.0, 4.0), (4.0, 0.0)]) for k in range(80)] + [(99, None)]
    _, edges = noding.node_lines(spark.createDataFrame(lines, LINES), 3.0, 1e-6)
    got = sorted((r["line_id"], r["seq"], round(r["length"], 6)) for r in edges.collect())
    assert got == [(k, i, round(math.sqrt(8), 6)) for k in range(80) for i in (1, 2)]
    assert rows["places"] == 2


def test_equal_shapes_are_covered_and_overlaid_once(spark, monkeypatch):
    """Ninety parcels of three shapes: three shapes are worked on, and every parcel gets its rows."""
    from pyspark.sql import functions as F

    from geoloom.functions import geo
    from geoloom.operators import graph, polygons

    rows, keep = {}, polygons.materialize

    def counted(df, label="part"):
        out = keep(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(polygons, "materialize", counted)
    x = (F.col("id") % 3).cast("double")
    a = spark.range(90).select("id", (F.col("id") % 2).alias("kind"), geo.box_ring(x, F.lit(0.0), x + 2, F.lit(2.0)).alias("ring"))
    b = spark.createDataFrame([(1,), (2,)], "id long").withColumn("ring", geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(3.0)))
    got = {(r["a_id"], r["b_id"]): round(r["area"], 9) for r in graph.overlay(a, b, 1.0).collect()}
    assert got == {(k, z): [4.0, 4.0, 2.0][k % 3] for k in range(90) for z in (1, 2)}
    assert rows["shapes"] == 3 and rows["legs"] <= 12
    cells = {(r["kind"], r["cx"], r["cy"]) for r in graph.dissolve(a, "kind", 1.0).collect()}
    assert cells == {(k, cx, cy) for k in (0, 1) for cx in range(4) for cy in range(2)}
    assert rows["cells"] == 12


def test_copies_of_roads_stay_one_row(spark, monkeypatch):
    """Roads that are there one to six times over: cleaning gives what it gives for all of them written out, from one row a road."""
    from geoloom.operators import noding

    rng = random.Random(21)
    own = [[(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(rng.randint(2, 4))] for _ in range(14)]
    own += [[(30.0, float(k)), (30.0, k + 1.0)] for k in range(5)] + [[(40.0, 0.0), (40.0, 5.0), (41.0, 5.0)], [(40.0, 0.0), (41.0, 5.0)]]
    times = [1 + k % 6 for k in range(14)] + [1, 2, 2, 3, 1, 2, 5]
    lines = [(100 * k + i, p) for k, (p, n) in enumerate(zip(own, times, strict=True)) for i in range(n)]
    df = spark.createDataFrame(lines, LINES)
    nodes, edges = noding.node_lines(df, 3.0, 1e-6)
    told = noding.clean_network(nodes, edges, 0.4)
    rows, keep = [], noding.materialize

    def counted(df, label="part"):
        out = keep(df, label)
        rows.append((label, out.count()))
        return out

    monkeypatch.setattr(noding, "materialize", counted)
    got = noding.road_network(df, 3.0, 1e-6, 0.4)
    figures = lambda parts: sorted((r["seq"], r["step"], r["edges"], round(r["length"], 6)) for r in parts[2].collect())
    table = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()))
    assert figures(got) == figures(told) and table(got[1]) == table(told[1]) and table(got[0]) == table(told[0])
    pieces = dict(rows)["pieces"]
    assert next(n for label, n in rows if label == "clean") == pieces < edges.count()


def test_noded_roads_of_repeated_suppliers_equal_the_sql(spark, sf, tmp_path, monkeypatch):
    """Suppliers repeated under shifted keys: equal roads, many that end in one place, one without a balance, one without a key."""
    import duckdb
    from pyspark.sql import functions as F

    from geoloom.operators import noding
    from geoloom.plans import catalog, catalog_shapes

    own = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey < 10")
    key, at = F.col("s_suppkey"), F.col("s_suppkey") + F.col("_k") * 1_000
    odd = own.filter(key == 1).withColumn("s_acctbal", F.lit(None).cast("double")).withColumn("s_suppkey", key + 77_000).unionByName(own.filter(key == 2).withColumn("s_suppkey", F.lit(None).cast("long")))
    many = own.crossJoin(spark.createDataFrame([(0,), (1,), (2,), (9,)], "_k long")).withColumn("s_suppkey", at).drop("_k").unionByName(odd)
    many.write.parquet(str(tmp_path / "supplier.parquet"))
    told = duckdb.connect()
    told.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = sorted(told.sql(catalog.ORACLES["noded_roads"]).fetchall())
    assert len(want) == 41 and len({r[1] for r in want}) > 5 and any(r[3] is None for r in want)
    got = lambda: sorted(tuple(r) for r in catalog_shapes.noded_roads(spark, str(tmp_path)).select("line_id", "pieces", "shortest", "length").collect())
    assert got() == want
    whole = noding.crossing_figures
    monkeypatch.setattr(noding, "crossing_figures", lambda roads: whole(roads, few=10))
    assert got() == want  # more roads than a task holds


def network_tables(parts):
    table = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    return [table(parts[0].select("node", "x", "y")), table(parts[1].select("u", "v", "length")), table(parts[2].select("seq", "step", "edges", "length"))]


@pytest.mark.parametrize("seed, radius", [(1, 0.3), (2, 0.02)])
def test_held_lines_give_the_network_of_written_ones(spark, monkeypatch, seed, radius):
    """Crossing, touching, overlapping, equal and odd lines: cut again in the tasks as they are when all pieces are written."""
    from geoloom.operators import cutting, noding
    from geoloom.operators.noding import road_network

    if seed == 2:  # more cells than are sent to the tasks
        monkeypatch.setattr(noding, "_MOST_CELLS", 0)
        monkeypatch.setattr(cutting.HeldLines.places_in, "__defaults__", (0,))

    rng = random.Random(seed)
    own = [[(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(rng.randint(2, 5))] for _ in range(25)]
    own += [[(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(1, 4))] for _ in range(25)]  # ends on others, runs along them, turns back
    own += [[(30.0, 30.0), (31.0, 30.0), (31.0, 31.0), (30.0, 30.0)], [(20.0, None), (20.0, 20.0), (21.0, 20.0)], [(2.0, 3.0), (2.0, 0.0000004)], [(40.0, 0.0000006), (44.0, 0.0)], [(42.0, 3.0), (42.0, 0.0)], None]
    times = [1 + k % 3 for k in range(len(own))]
    df = spark.createDataFrame([(10 * k + i, p) for k, (p, n) in enumerate(zip(own, times, strict=True)) for i in range(n)], LINES)
    told = network_tables(road_network(df, 3.0, 1e-6, radius, least=10**9))
    assert network_tables(road_network(df, 3.0, 1e-6, radius, least=1)) == told
    assert len(told[0]) > 20 and len(told[1]) > 40


def test_pieces_of_a_dense_network_are_not_written(spark, monkeypatch):
    """Five hundred roads that nearly all cross: no table that is written has a row for every piece."""
    from geoloom.operators import components, graph, noding, spatial

    rng = random.Random(5)
    ends = lambda: (rng.uniform(0, 20), rng.uniform(0, 20))
    lines = [(k, [ends(), ends()]) for k in range(500)] + [(600 + k, [(30.0 + k, 0.0), (30.0 + k, 9.0)]) for k in range(6)]
    df = spark.createDataFrame(lines, LINES)
    rows, keep = [], noding.materialize

    def counted(df, label="part"):
        out = keep(df, label)
        rows.append(out.count())
        return out

    for module in (components, graph, noding, spatial):
        monkeypatch.setattr(module, "materialize", counted)
    report = {r["step"]: r["edges"] for r in noding.road_network(df, 3.0, 1e-6, 0.5)[2].collect()}
    assert report["given"] > 50_000 and report["junctions merged"] >= 6
    assert max(rows) < report["given"] / 2


def test_near_components_by_small_chunks(spark):
    from geoloom.operators.components import connected_components, near_components

    rng = random.Random(8)
    edges = spark.createDataFrame([(k, k + rng.randint(-3, 3)) for k in range(0, 900, 2)] + [(5, 5), (2000, 2001), (3000, 7)], "u long, v long")
    told = {tuple(r) for r in connected_components(edges).collect()}
    for few in (7, 500_000):
        assert {tuple(r) for r in near_components(edges, few).collect()} == told
    assert near_components(edges.limit(0)).collect() == []
