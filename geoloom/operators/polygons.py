"""Polygons of any shape: quadtree coverings, and the joins that work on them.

Polygons are rows with a ``ring`` (closed, array<struct<x, y>>) or with ``rings``
(an array of such); by the even-odd rule rings may be concave, be holes in others,
or be several parts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import cell, clip_ring, ring_area
from geoloom.plans.materialize import materialize

#: Part of a cell's width by which legs are taken wider, so that rounding hides none.
_WIDER = 1e-6


def ring_legs(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """(key, ring, leg, ax, ay, bx, by): the legs of every ring, in order."""
    rings = F.array("ring") if "ring" in polygons.columns else F.col("rings")
    each = polygons.select(key, F.posexplode(rings).alias("ring", "_ring"))
    n = F.greatest(F.size("_ring") - 1, F.lit(0))
    legs = F.zip_with(F.slice("_ring", 1, n), F.slice("_ring", 2, n), lambda a, b: F.struct(*(p[c].cast("double").alias(f"{k}{c}") for k, p in (("a", a), ("b", b)) for c in ("x", "y"))))
    return each.select(key, "ring", F.posexplode(legs).alias("leg", "_leg")).select(key, "ring", "leg", "_leg.*")


def touched_cells(legs: DataFrame, width: Column, wider: Column | None = None) -> DataFrame:
    """``legs`` (ax, ay, bx, by, ...) repeated with cx, cy for each cell, ``width``
    wide, that the leg touches: band by band, so a slanted leg meets about as many
    cells as it crosses, not its whole bounding box. A little more than touched
    is taken, so that rounding leaves no cell out."""
    c, eps = F.col, width * _WIDER if wider is None else wider
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    band = legs.withColumn("cy", F.explode(F.sequence(F.floor((low - eps) / width).cast("long"), F.floor((high + eps) / width).cast("long"))))
    at = lambda y: c("ax") + (c("bx") - c("ax")) * (F.least(F.greatest(y, low), high) - c("ay")) / (c("by") - c("ay"))
    one = F.when(c("ay") == c("by"), c("ax")).otherwise(at(c("cy") * width - eps))
    two = F.when(c("ay") == c("by"), c("bx")).otherwise(at((c("cy") + 1) * width + eps))
    return band.withColumn("cx", F.explode(F.sequence(F.floor((F.least(one, two) - eps) / width).cast("long"), F.floor((F.greatest(one, two) + eps) / width).cast("long"))))


def covering(polygons: DataFrame, size: float, budget: int = 1_024, key: str = "poly_id") -> DataFrame:
    """(key, level, cx, cy, odd, legs): quadtree cells that cover each polygon. A cell
    of level l is ``size`` * 2^l wide; cx and cy number such cells.

    The border lies in cells of one level: the finest (from 0 up) at which a curve
    as long as the polygon's legs can't touch more than ``budget`` cells. They
    carry the legs that a ray from them to the right may cross, and ``odd``, how
    many of the others it surely crosses, modulo 2. Between them come inner
    cells, as large as fit, whose ``legs`` are null: they lie inside as a whole
    and need no test. So a polygon has at most 5 * ``budget`` rows and 16 for
    each level, whatever its size or the fineness of ``size``, and not a row for
    every cell of its bounding box.
    """
    c = F.col
    legs = ring_legs(polygons, key).drop("ring", "leg").filter("ax is not null and ay is not null and bx is not null and by is not null")
    legs = materialize(legs, "legs")
    box = legs.groupBy(key).agg(
        F.sum(F.hypot(c("bx") - c("ax"), c("by") - c("ay"))).alias("_p"),
        F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("_wide"),
    )
    level = lambda x: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(x / size, F.lit(1e-9))))).cast("int")
    box = box.select(key, level(c("_p") * (4.0 / max(4, budget - 4))).alias("_fine"), level(c("_wide")).alias("_top"))
    sized = materialize(legs.join(box.withColumn("_top", F.greatest("_fine", "_top")), key), "legs")
    width = lambda at: F.lit(float(size)) * F.pow(F.lit(2.0), at)
    fine = touched_cells(sized, width(c("_fine"))).select(key, "_fine", "_top", "cx", "cy").distinct()
    up = fine.withColumn("level", F.explode(F.sequence("_fine", "_top")))
    border = up.select(key, "_fine", "level", *(F.expr(f"shiftright({x}, level - _fine)").alias(x) for x in ("cx", "cy"))).distinct()
    border = materialize(border, "border")
    child = border.filter("level > _fine").withColumns({"_i": F.explode(F.array(F.lit(0), F.lit(1)))}).withColumns({"_j": F.explode(F.array(F.lit(0), F.lit(1)))})
    child = child.select(key, (c("level") - 1).alias("level"), (c("cx") * 2 + c("_i")).alias("cx"), (c("cy") * 2 + c("_j")).alias("cy"))
    open_cells = child.join(border.select(key, "level", "cx", "cy"), [key, "level", "cx", "cy"], "left_anti").withColumn("edge", F.lit(False))
    cells = open_cells.unionByName(border.filter("level = _fine").select(key, "level", "cx", "cy", F.lit(True).alias("edge")))
    # Legs meet the cells of their bands, at each level.
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    banded = sized.withColumn("level", F.explode(F.sequence("_fine", "_top"))).drop("_fine", "_top").withColumn("_w", width(c("level")))
    banded = banded.withColumn("cy", F.explode(F.sequence(F.floor((low - c("_w") * _WIDER) / c("_w")).cast("long"), F.floor((high + c("_w") * _WIDER) / c("_w")).cast("long"))))
    met = cells.join(banded, [key, "level", "cy"])
    x0, y0, eps = c("cx") * c("_w"), c("cy") * c("_w"), c("_w") * _WIDER
    surely = (F.least("ax", "bx") > x0 + c("_w") + eps) & (low <= y0) & (high >= y0 + c("_w"))
    maybe = (F.greatest("ax", "bx") >= x0 - eps) & ~surely
    mid = crosses(x0 + c("_w") / 2, y0 + c("_w") / 2, c("ax"), c("ay"), c("bx"), c("by"))
    grouped = met.groupBy(key, "level", "cx", "cy", "edge").agg(
        (F.sum(F.when(c("edge"), surely.cast("int")).otherwise(mid.cast("int"))) % 2).cast("int").alias("odd"),
        F.collect_list(F.when(c("edge") & maybe, F.struct("ax", "ay", "bx", "by"))).alias("legs"),
    )
    return grouped.filter("edge or odd = 1").select(key, "level", "cx", "cy", F.when(c("edge"), c("odd")).otherwise(0).alias("odd"), F.when(c("edge"), c("legs")).alias("legs"))


def crosses(x, y, ax, ay, bx, by) -> Column:
    """Whether a ray from (x, y) to the right crosses a leg; an end counts with what lies above it."""
    hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return F.when(ay == by, F.lit(False)).otherwise(hit)


def inside_cell(x, y, odd: Column, legs: Column) -> Column:
    """Whether a point of a covering's cell lies in the polygon."""
    hits = F.aggregate(legs, odd, lambda s, g: s + crosses(x, y, g["ax"], g["ay"], g["bx"], g["by"]).cast("int"))
    return legs.isNull() | (hits % 2 == 1)


def _levels(cover: DataFrame) -> list[int]:
    return sorted(r[0] for r in cover.select("level").distinct().collect())  # at most a few dozen: one for each doubling of size


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, budget: int = 1_024, by: Sequence[str] = ()) -> DataFrame:
    """points(id, x, y, ...) with poly_id of each polygon(poly_id, ring or rings) that holds
    it, of those whose columns ``by`` equal the point's.

    Polygons are covered by quadtree cells (:func:`covering`), points look up
    their cell at each level in use. A hit in an inner cell is settled; in a
    border cell the even-odd rule decides by the few legs kept there. Points
    without coordinates are in no polygon."""
    cover = materialize(covering(polygons, size, budget), "covering")
    levels = _levels(cover)
    if not levels:
        return points.crossJoin(polygons.select("poly_id").limit(0))
    own = [F.col(c) for c in points.columns]
    at = points.withColumns({"_x": cell(F.col("x"), size), "_y": cell(F.col("y"), size)}).withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels))))
    at = at.select(*own, "level", F.expr("shiftright(_x, level)").alias("_cx"), F.expr("shiftright(_y, level)").alias("_cy"))
    if by:
        cover = cover.join(polygons.select("poly_id", *by), "poly_id")
    held = cover.select("poly_id", "level", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("odd").alias("_odd"), F.col("legs").alias("_legs"), *by)
    met = at.join(held, ["level", "_cx", "_cy", *by])
    return met.filter(inside_cell(F.col("x"), F.col("y"), F.col("_odd"), F.col("_legs"))).select(*points.columns, "poly_id")


def covered_cells(polygons: DataFrame, key: str, size: float, budget: int = 1_024) -> DataFrame:
    """(key, cx, cy): the cells, ``size`` wide, whose centres lie in the polygon(key, ring or rings).

    Inner cells of the covering are written out as they are; only centres in
    border cells are tested."""
    fan = covering(polygons, size, budget, key).withColumn("_n", F.expr("shiftleft(1L, level)"))
    fan = fan.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    spread = fan.select(key, (F.col("cx") * F.col("_n") + F.col("_i")).alias("cx"), (F.col("cy") * F.col("_n") + F.col("_j")).alias("cy"), "odd", "legs")
    inside = inside_cell((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("odd"), F.col("legs"))
    return spread.filter(inside).select(key, "cx", "cy")


def distinct_shapes(polygons: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(shapes, members): shapes(shape, ring or rings), each of those of polygons(*keys,
    ring or rings) once, and members(*keys, shape). What only depends on the shape
    is then worked out once, however many polygons have it."""
    drawn = "ring" if "ring" in polygons.columns else "rings"
    shapes = materialize(polygons.select(drawn).filter(F.col(drawn).isNotNull()).distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return shapes, polygons.select(*keys, drawn).join(shapes, drawn).select(*keys, "shape")


def dissolved_cells(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(<key>, cx, cy): the cells, ``size`` wide, whose centres lie in any polygon(<key>, ring or rings) of the key, each once.

    A shape is covered by itself and once; the key may have any number."""
    shapes, members = distinct_shapes(polygons, [key])
    members = materialize(members.distinct(), "members")
    cells = materialize(covered_cells(shapes, "shape", size), "cells")
    return materialize(cells.join(members, "shape").select(key, "cx", "cy").distinct(), "dissolved")


def touching_pairs(a: DataFrame, b: DataFrame, size: float, budget: int = 256) -> DataFrame:
    """(a_id, b_id): the pairs of a(id, ring or rings) and b whose coverings share a
    cell, each once: all that have a point in common, and few others."""
    one, two = (materialize(covering(p, size, budget, "id").select("id", "level", "cx", "cy"), "covering") for p in (a, b))
    levels = sorted({*_levels(one), *_levels(two)})
    up = F.explode(F.filter(F.array(*(F.lit(v) for v in levels or [0])), lambda v: v >= F.col("level")))
    fan = lambda df, to: df.withColumn("_at", up).select(F.col("id").alias(to), F.col("_at").alias("at"), *(F.expr(f"shiftright({x}, _at - level)").alias(x) for x in ("cx", "cy")), (F.col("_at") == F.col("level")).alias(f"{to}_own"))
    # Of two cells that share ground one holds the other, so they meet at the level of the larger.
    met = fan(one, "a_id").join(fan(two, "b_id"), ["at", "cx", "cy"]).filter("a_id_own or b_id_own")
    return met.select("a_id", "b_id").distinct()


def most_rows(budget: int, levels: int) -> int:
    """The bound on a polygon's rows that :func:`covering` keeps."""
    return 5 * budget + 16 * levels


def levels_of(size: float, wide: float) -> int:
    """How many levels a polygon ``wide`` across may have."""
    return 1 + max(0, math.ceil(math.log2(max(wide / size, 1e-9))))


# --- pieces of polygons ---------------------------------------------------------------------


def trapezoids(polygons: DataFrame, key: str = "id") -> DataFrame:
    """(key, piece, ring): polygon(key, ring or rings) cut at the heights of all its
    corners into trapezoids with level tops and bottoms, closed and
    counter-clockwise. Their areas add up to the polygon's, whatever its shape;
    its legs must not cross (they may touch).

    Each leg is written once for each band between two corners' heights that it
    spans, and the legs of a band pair off from left to right."""
    c = F.col
    legs = ring_legs(polygons, key).filter("ay <> by").select(key, *(F.when(c("ay") < c("by"), c(a)).otherwise(c(b)).alias(n) for n, a, b in (("x0", "ax", "bx"), ("y0", "ay", "by"), ("x1", "bx", "ax"), ("y1", "by", "ay"))))
    legs = materialize(legs, "legs")
    heights = legs.select(key, c("y0").alias("y")).union(legs.select(key, "y1")).distinct()
    w = Window.partitionBy(key).orderBy("y")
    bands = materialize(heights.withColumn("k", F.row_number().over(w)).withColumn("top", F.lead("y").over(w)), "bands")
    rank = lambda y, to: bands.select(key, c("y").alias(y), c("k").alias(to))
    spans = legs.join(rank("y0", "k0"), [key, "y0"]).join(rank("y1", "k1"), [key, "y1"]).withColumn("k", F.explode(F.sequence("k0", F.col("k1") - 1)))
    placed = spans.join(bands.select(key, "k", c("y").alias("low"), "top"), [key, "k"])
    at = lambda y: F.when(y == c("y0"), c("x0")).when(y == c("y1"), c("x1")).otherwise(c("x0") + (c("x1") - c("x0")) * (y - c("y0")) / (c("y1") - c("y0")))
    sides = placed.select(key, "k", "low", "top", at(c("low")).alias("xl"), at(c("top")).alias("xt"))
    order = Window.partitionBy(key, "k").orderBy(c("xl") + c("xt"), "xl", "xt")
    paired = sides.withColumn("_n", F.row_number().over(order) - 1).withColumn("_pair", F.call_function("div", c("_n"), F.lit(2)))
    left, right = (F.max(F.when(c("_n") % 2 == i, F.struct("xl", "xt"))) for i in (0, 1))
    both = paired.groupBy(key, "k", "_pair").agg(F.first("low").alias("low"), F.first("top").alias("top"), left.alias("l"), right.alias("r"))
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    start = spot(c("l.xl"), c("low"))
    ring = F.array(start, spot(c("r.xl"), c("low")), spot(c("r.xt"), c("top")), spot(c("l.xt"), c("top")), start)
    return both.filter("r is not null and (r.xl > l.xl or r.xt > l.xt)").select(key, F.struct("k", "_pair").alias("piece"), ring.alias("ring"))


def _half(ring: Column, a: Column, b: Column, inside: bool) -> Column:
    """The part of an open convex ring on the left of the line from a to b, or on its right."""
    far = lambda p: ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])) * (1 if inside else -1)
    last = F.concat(F.slice(ring, F.size(ring), F.when(F.size(ring) > 0, 1).otherwise(0)), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

    def step(p: Column, q: Column) -> Column:
        d, e = far(p), far(q)
        t = d / F.nullif(d - e, F.lit(0.0))
        met = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.concat(F.when((d >= 0) != (e >= 0), F.array(met)).otherwise(F.slice(ring, 1, 0)), F.when(e >= 0, F.array(q)).otherwise(F.slice(ring, 1, 0)))

    return F.when(F.size(ring) > 0, F.flatten(F.zip_with(last, ring, step))).otherwise(ring)


def _open(ring: Column) -> Column:
    return F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))


def subtract(ring: Column, others: Column) -> Column:
    """What is left of a convex ring (closed, counter-clockwise) without those of an
    array, as an array of closed convex rings."""

    def without(piece: Column, other: Column) -> Column:
        walls = F.zip_with(_open(other), F.slice(other, 2, F.greatest(F.size(other) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        walls = F.filter(walls, lambda e: e["a"] != e["b"])
        cut = lambda s, e: F.struct(_half(s["rest"], e["a"], e["b"], True).alias("rest"), F.concat(s["out"], F.array(_half(s["rest"], e["a"], e["b"], False))).alias("out"))
        start = F.struct(piece.alias("rest"), F.slice(F.array(piece), 1, 0).alias("out"))
        return F.filter(F.aggregate(walls, start, cut)["out"], lambda r: F.size(r) > 2)

    pieces = F.aggregate(others, F.array(_open(ring)), lambda s, other: F.flatten(F.transform(s, lambda piece: without(piece, other))))
    return F.transform(pieces, lambda r: F.concat(r, F.slice(r, 1, 1)))


def overlay(a: DataFrame, b: DataFrame, size: float, how: str = "intersection", least: float = 1e-12) -> DataFrame:
    """(a_id, b_id, area, pieces) of a(id, ring or rings) and b(id, ring or rings) of any
    shape: the common part of each pair as convex pieces; with how="union" also
    what is left of each a (b_id null) and of each b (a_id null). Pieces smaller
    than ``least`` go; pairs or rests without any have no row.

    Both sides are cut into trapezoids, whose coverings meet in cells; two
    trapezoids are clipped, and a rest is a trapezoid less all that meet it."""
    if how not in ("intersection", "union"):
        raise ValueError(f"no such overlay: {how}")
    number = lambda df: materialize(trapezoids(df, "id").select(F.monotonically_increasing_id().alias("t"), "id", "ring"), "trapezoids")
    one, two = number(a), number(b)
    pairs = touching_pairs(one.select(F.col("t").alias("id"), "ring"), two.select(F.col("t").alias("id"), "ring"), size, 64)
    of = lambda df, k: df.select(F.col("t").alias(f"{k}_id"), F.col("id").alias(f"_{k}"), F.col("ring").alias(f"{k}_ring"))
    met = pairs.join(of(one, "a"), "a_id").join(of(two, "b"), "b_id")
    cut = met.withColumn("ring", clip_ring(F.col("a_ring"), F.col("b_ring"))).withColumn("area", F.abs(ring_area(F.col("ring")))).filter(F.col("area") > least)
    cut = materialize(cut.select("a_id", "b_id", "_a", "_b", "a_ring", "b_ring", "ring", "area"), "common")
    total = lambda df, x, y: df.groupBy(x.alias("a_id"), y.alias("b_id")).agg(F.sum("area").alias("area"), F.collect_list("ring").alias("pieces"))
    out = total(cut, F.col("_a"), F.col("_b"))
    if how == "union":
        for mine, own, k, other in ((one, "a", 0, "b"), (two, "b", 1, "a")):
            against = cut.groupBy(F.col(f"{own}_id").alias("t")).agg(F.collect_list(f"{other}_ring").alias("_against"))
            rest = mine.join(against, "t", "left").withColumn("ring", F.explode(F.when(F.col("_against").isNull(), F.array("ring")).otherwise(subtract(F.col("ring"), F.col("_against")))))
            rest = rest.withColumn("area", F.abs(ring_area(F.col("ring")))).filter(F.col("area") > least)
            none = F.lit(None).cast(dict((b if own == "a" else a).dtypes)["id"])
            out = out.unionByName(total(rest, *((F.col("id"), none) if k == 0 else (none, F.col("id")))))
    return out
