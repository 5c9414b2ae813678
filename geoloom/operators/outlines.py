"""Outlines of areas: from cells to rings with holes, and what is built of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.polygons import dissolved_cells, points_in_polygons
from geoloom.operators.routing import isochrone_cells
from geoloom.plans.materialize import materialize

#: A cell's sides, run round with the cell on the left: from corner, to corner (east, north, west, south).
_SIDES = (((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0)))


def boundary(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, dir, ax, ay): the sides of cells(*by, cx, cy) with no cell of the group
    beyond, from corner (ax, ay) towards dir (0 east, 1 north, 2 west, 3 south),
    the area on the left. Sides that two cells share run both ways and cancel."""
    sides = F.array(*(F.struct(F.lit(d).alias("dir"), (F.col("cx") + a[0]).alias("ax"), (F.col("cy") + a[1]).alias("ay"), (F.col("cx") + min(a[0], b[0])).alias("lx"), (F.col("cy") + min(a[1], b[1])).alias("ly")) for d, (a, b) in enumerate(_SIDES)))
    each = cells.select(*by, "cx", "cy").distinct().select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    met = each.groupBy(*by, "lx", "ly", (F.col("dir") % 2).alias("_way")).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("dir", "ax", "ay")))
    return met.filter("n = 1").select(*by, "dir", "ax", "ay")


def next_sides(sides: DataFrame, by: Sequence[str], corners: bool = False) -> DataFrame:
    """sides with ``side`` (a number) and ``next``: the side that follows on the outline.

    Where two areas touch at a corner only, the outline turns left, so that they
    stay two; with ``corners`` right, so that they are one."""
    own = materialize(sides.withColumn("side", F.monotonically_increasing_id()), "sides")
    dx, dy = (F.element_at(F.array(*(F.lit(v) for v in x)), F.col("dir") + 1) for x in ((1, 0, -1, 0), (0, 1, 0, -1)))
    head = own.withColumns({"hx": F.col("ax") + dx, "hy": F.col("ay") + dy})
    after = own.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("dir").alias("_dir"), F.col("ax").alias("_ax"), F.col("ay").alias("_ay"), F.col("side").alias("_next"))
    same = (F.col("hx") == F.col("_ax")) & (F.col("hy") == F.col("_ay"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = head.join(after, same)
    turn = F.pmod(F.col("_dir") - F.col("dir"), F.lit(4))  # 1 left, 0 straight on, 3 right
    rank = F.when(turn == 1, 2).when(turn == 3, 0).otherwise(1) if corners else F.when(turn == 1, 0).when(turn == 3, 2).otherwise(1)
    return met.groupBy("side").agg(F.min_by("_next", rank).alias("next"), *(F.first(c).alias(c) for c in (*by, "dir", "ax", "ay")))


def ring_order(links: DataFrame) -> DataFrame:
    """(side, ring, place) of links(side, next), in which every side has one next and
    one before it: the ring's smallest side names it, place counts from that.

    By pointer doubling: each round every side looks twice as far ahead, so a
    ring of n sides takes about log2(n) rounds, all rings at once."""
    far = materialize(links.select("side", F.col("next").alias("to"), F.least("side", "next").alias("low")), "far")
    while True:
        ahead = far.select(F.col("side").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        now = materialize(far.join(ahead, "to").select("side", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell")), "far")
        far = now.drop("fell")
        if now.filter("fell").isEmpty():
            break
    named = far.select("side", F.col("low").alias("ring"))
    # Cut open before its smallest side, a ring is a list: steps to its end, again by doubling.
    back = links.join(named, "side").select("side", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"))
    left = materialize(back.withColumn("steps", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long")), "left")
    while not left.filter("to is not null").isEmpty():
        ahead = left.select(F.col("side").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        open_ends = left.filter("to is not null").join(ahead, "to").select("side", "ring", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"))
        left = materialize(left.filter("to is null").select("side", "ring", "to", "steps").unionByName(open_ends), "left")
    first = left.filter("side = ring").select("ring", F.col("steps").alias("_all"))
    return left.join(first, "ring").select("side", "ring", (F.col("_all") - F.col("steps")).alias("place"))


def outlines(cells: DataFrame, by: Sequence[str], size: float = 1.0, corners: bool = False) -> DataFrame:
    """(*by, part, area, perimeter, n_corners, rings) of the areas that cells(*by, cx, cy)
    make: one row a part, its outer ring (counter-clockwise) first, then its holes
    (clockwise), each closed, with corners only where it turns.

    Shared sides cancel, what is left is strung into rings by pointer doubling,
    and a hole goes to the smallest outer ring of its group around it. Cells are
    ``size`` wide and count from the origin; repeated ones count once; cells that
    touch at a corner only are joined by ``corners``."""
    by, c = list(by), F.col
    links = materialize(next_sides(boundary(cells, by), by, corners), "links")
    placed = links.join(ring_order(links), "side")
    turns = placed.join(links.select(c("side").alias("next"), c("dir").alias("_dir")), "next")
    shape = placed.groupBy("ring").agg(
        *(F.first(x).alias(x) for x in by),
        F.sum(F.when(c("dir") == 1, c("ax")).when(c("dir") == 3, -c("ax")).otherwise(0)).alias("cells"),
        F.count(F.lit(1)).alias("sides"),
        F.min_by(F.struct("dir", "ax", "ay"), "side").alias("one"),
    )
    # A turn's corner is the head of its side; the ring begins and ends with the first.
    spots = turns.filter("dir <> _dir").withColumn("p", F.struct((c("ax") + F.when(c("dir") == 0, 1).when(c("dir") == 2, -1).otherwise(0)).cast("double").alias("x"), (c("ay") + F.when(c("dir") == 1, 1).when(c("dir") == 3, -1).otherwise(0)).cast("double").alias("y")))
    rings = spots.groupBy("ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda s: F.struct((s["p"]["x"] * size).alias("x"), (s["p"]["y"] * size).alias("y"))).alias("points"))
    rings = materialize(rings.withColumn("points", F.concat("points", F.slice("points", 1, 1))).join(shape, "ring"), "rings")
    outer, holes = rings.filter("cells > 0"), rings.filter("cells < 0")
    # The cell to the left of one of a hole's sides lies in the part that the hole belongs to.
    inside_x = c("one.ax") + F.when(c("one.dir") == 0, 0.5).when(c("one.dir") == 1, -0.5).when(c("one.dir") == 2, -0.5).otherwise(0.5)
    inside_y = c("one.ay") + F.when(c("one.dir") == 0, 0.5).when(c("one.dir") == 1, 0.5).when(c("one.dir") == 2, -0.5).otherwise(-0.5)
    owner = outer.select(c("ring").alias("outer_ring"), c("cells").alias("outer_cells"))
    inner = holes.select(c("ring").alias("id"), (inside_x * size).alias("x"), (inside_y * size).alias("y"), *by)
    around = points_in_polygons(inner, outer.select(c("ring").alias("poly_id"), c("points").alias("ring"), *by), size, by=by)
    held = around.join(owner, around["poly_id"] == owner["outer_ring"]).groupBy(c("id").alias("ring")).agg(F.min_by("outer_ring", F.struct("outer_cells", "outer_ring")).alias("part"))
    every = outer.withColumn("part", c("ring")).unionByName(holes.join(held, "ring").select(*rings.columns, "part"))
    grouped = every.groupBy("part").agg(
        *(F.first(x).alias(x) for x in by),
        (F.sum("cells") * (size * size)).alias("area"),
        (F.sum("sides") * size).alias("perimeter"),
        F.sum(F.size("points") - 1).alias("n_corners"),
        F.transform(F.array_sort(F.collect_list(F.struct((-c("cells")).alias("order"), "ring", "points"))), lambda s: s["points"]).alias("rings"),
    )
    return grouped.select(*by, "part", "area", "perimeter", "n_corners", "rings")


def dissolved_outlines(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """:func:`outlines` of polygon(key, ring or rings) laid together by key, on cells ``size`` wide."""
    return outlines(dissolved_cells(polygons, key, size), [key], size)


def value_polygons(cells: DataFrame, value: str = "value", size: float = 1.0, corners: bool = False) -> DataFrame:
    """:func:`outlines` of the contiguous cells(cx, cy, value) of each value."""
    return outlines(cells.select(value, "cx", "cy"), [value], size, corners)


def isochrone_polygons(paths: DataFrame, nodes: DataFrame, thresholds: Sequence[float], size: float, around: int = 1) -> DataFrame:
    """:func:`outlines` by origin and threshold of the cells around the nodes(node, x, y)
    that paths(o, node, cost) reach in time."""
    return outlines(isochrone_cells(paths, nodes, list(thresholds), size, around), ["o", "threshold"], size)
