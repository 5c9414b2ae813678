"""Spatial joins by grid cells: equi-joins on a cell, then an exact test."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import cell
from geoloom.operators.components import connected_components, near_components
from geoloom.operators.polygons import points_in_polygons  # noqa: F401  it stands with the other joins
from geoloom.plans.materialize import broadcast_if_small, materialize, ship_package


def _with_cells(points: DataFrame, size, around: int) -> DataFrame:
    """Rows repeated for the cells up to ``around`` away in each direction."""
    df = points.withColumns({"_cx": cell(F.col("x"), size), "_cy": cell(F.col("y"), size)})
    if around:
        span = F.sequence(F.lit(-around), F.lit(around))
        df = df.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
        df = df.withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")
    return df


def distinct_places(points: DataFrame) -> DataFrame:
    """(id, x, y): the places of points(x, y, ...), each once, under numbers of their own; points without coordinates have none."""
    known = points.select("x", "y").filter("x is not null and y is not null").distinct()
    return materialize(known.withColumn("id", F.monotonically_increasing_id()), "places")


def within_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, dist): pairs of a(id, x, y) and b(id, x, y) at most ``radius`` apart."""
    left = _with_cells(a.select(F.col("id").alias("a_id"), "x", "y"), radius, 1).withColumnsRenamed({"x": "ax", "y": "ay"})
    right = _with_cells(b.select(F.col("id").alias("b_id"), "x", "y"), radius, 0)
    dist = F.sqrt(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2))
    return left.join(right, ["_cx", "_cy"]).withColumn("dist", dist).filter(F.col("dist") <= radius).select("a_id", "b_id", "dist")


def close_groups(points: DataFrame, radius: float) -> DataFrame:
    """(id, x, y, group) of points(id, x, y): those within ``radius`` of each other, in
    turn, share a group, which is named by its smallest id. Points without a finite
    place stand alone, and with a radius of 0 all do.

    Points of one cell are never farther apart than ``radius``, so cells are grouped
    and no list of pairs of points is made: first by their outermost points towards
    each other, which joins what is crowded; then points are compared, but only of
    cells that are still apart and only those near enough to the other cell."""
    c = F.col
    finite = F.coalesce(F.abs("x") + F.abs("y") < float("inf"), F.lit(False))
    alone = points.select("id", "x", "y", c("id").alias("group"))
    if radius <= 0:
        return alone
    width = close_width(radius)
    placed = materialize(points.select("id", "x", "y").filter(finite).withColumns({"cx": cell(c("x"), width), "cy": cell(c("y"), width)}), "placed")
    joined = close_cells(placed, lambda cells: placed.join(broadcast_if_small(cells, 500_000), ["cx", "cy"], "left_semi"), radius, F.min("id").alias("first"))
    names = joined.groupBy("part").agg(F.min("first").alias("group"))
    return placed.join(joined.join(names, "part").select("cx", "cy", "group"), ["cx", "cy"]).select("id", "x", "y", "group").unionByName(alone.filter(~finite))


def close_width(radius: float) -> float:
    """The width of cells whose points are never farther apart than ``radius``."""
    return radius / math.sqrt(2) * (1 - 1e-6)


def close_cells(placed: DataFrame, points_of: Callable[[DataFrame], DataFrame], radius: float, *more: Column) -> DataFrame:
    """(cx, cy, part, ...): the groups of cells, :func:`close_width` wide, whose points lie
    within ``radius`` of each other, in turn, and the aggregates ``more``. ``placed``(cx,
    cy, x, y) has at least the outermost points of each cell; ``points_of`` gives all
    points of the cells(cx, cy) that it is given."""
    c = F.col
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # How far out the cell's points are in a direction, and where across the outermost one is.
    ways = {"e": (c("x"), c("y")), "n": (c("y"), c("x")), "ne": (c("x") + c("y"), c("x") - c("y")), "se": (c("x") - c("y"), c("x") + c("y"))}
    tips = [t for w, (out, across) in ways.items() for t in (F.min(out).alias(f"low_{w}"), F.max(out).alias(f"top_{w}"), F.min_by(across, out).alias(f"low_{w}_at"), F.max_by(across, out).alias(f"top_{w}_at"))]
    kept = placed.agg(*more).columns if more else []
    # Cells next to each other get numbers near each other.
    cells = placed.groupBy("cx", "cy").agg(*more, *tips).repartitionByRange(tasks, "cx", "cy").sortWithinPartitions("cx", "cy")
    cells = materialize(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    steps = {"e": (1, 0, 1.0), "n": (0, 1, 1.0), "ne": (1, 1, 0.5), "se": (1, -1, 0.5)}
    tip = lambda k: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("s"), c(f"{k}_{w}").alias("out"), c(f"{k}_{w}_at").alias("at")) for w, (i, j, s) in steps.items())))
    one = cells.select(c("cell").alias("u"), "cx", "cy", tip("top").alias("p")).select("u", (c("cx") + c("p.i")).alias("cx"), (c("cy") + c("p.j")).alias("cy"), c("p.i").alias("i"), c("p.j").alias("j"), "p")
    two = cells.select(c("cell").alias("v"), "cx", "cy", tip("low").alias("q")).select("v", "cx", "cy", c("q.i").alias("i"), c("q.j").alias("j"), "q")
    apart = c("p.s") * (F.pow(c("p.out") - c("q.out"), 2) + F.pow(c("p.at") - c("q.at"), 2))
    sure = one.join(two, ["cx", "cy", "i", "j"]).filter(apart <= (radius * (1 - 1e-9)) ** 2).select("u", "v")
    parts = cells.join(near_components(sure).withColumnRenamed("node", "cell"), "cell", "left")
    parts = materialize(parts.select("cx", "cy", *kept, F.coalesce("component", "cell").alias("part"), c("low_e").alias("w"), c("top_e").alias("e"), c("low_n").alias("s"), c("top_n").alias("n")), "parts")
    # Cells up to two away may hold points within the radius; those of one part need no look.
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0))))
    first = parts.select(c("cx").alias("ux"), c("cy").alias("uy"), c("part").alias("u"), *(c(k).alias(f"u_{k}") for k in "wesn"), around.alias("_s"))
    first = first.withColumns({"cx": c("ux") + c("_s.i"), "cy": c("uy") + c("_s.j")}).drop("_s")
    wider = radius * (1 + 1e-9)
    gap = lambda a, b: F.greatest(F.lit(0.0), a, b)
    met = first.join(parts.select("cx", "cy", c("part").alias("v"), *(c(k).alias(f"v_{k}") for k in "wesn")), ["cx", "cy"]).filter("u <> v")
    met = met.filter(F.hypot(gap(c("u_w") - c("v_e"), c("v_w") - c("u_e")), gap(c("u_s") - c("v_n"), c("v_s") - c("u_n"))) <= wider)
    met = materialize(met, "met")
    looked = materialize(met.select(c("ux").alias("cx"), c("uy").alias("cy")).union(met.select("cx", "cy")).distinct(), "looked")
    spots = materialize(points_of(looked).select("cx", "cy", "x", "y").distinct(), "near")
    ours = met.join(spots.select(c("cx").alias("ux"), c("cy").alias("uy"), c("x").alias("px"), c("y").alias("py")), ["ux", "uy"])
    ours = ours.filter(F.hypot(gap(c("v_w") - c("px"), c("px") - c("v_e")), gap(c("v_s") - c("py"), c("py") - c("v_n"))) <= wider)
    dist = F.sqrt(F.pow(c("px") - c("x"), 2) + F.pow(c("py") - c("y"), 2))
    links = ours.join(spots, ["cx", "cy"]).filter(dist <= radius).select("u", "v").distinct()
    joined = parts.join(connected_components(links).withColumnRenamed("node", "part"), "part", "left").select("cx", "cy", *kept, F.coalesce("component", "part").alias("part"))
    return materialize(joined, "groups")


def nearest_join(a: DataFrame, b: DataFrame, size: float, k: int = 1, max_rounds: int = 40) -> DataFrame:
    """(a_id, b_id, dist, rank): the k nearest of b for each of a, ties by b's id.

    Places are searched for, not points: points of a that share a place share what
    is found there, and of those of b that do only the first k can count. Places
    look into the cells around their own; those whose k-th neighbour is no
    farther than a cell is wide are settled, the others go on with cells twice
    as wide, until the cells span all of b: exact, and only unsettled places are
    searched again. ``size`` is the widest start: cells that would hold many
    places of b on average start narrower."""
    points = materialize(a.select(F.col("id").alias("a_id"), "x", "y"), "points")
    spots = distinct_places(points).withColumnRenamed("id", "a_id")
    first = Window.partitionBy("bx", "by").orderBy("b_id")
    targets = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")).filter("bx is not null and by is not null")
    right = materialize(targets.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n"), "targets")
    box = right.agg(F.min("bx"), F.max("bx"), F.min("by"), F.max("by"), F.count(F.lit(1))).first()
    mine = spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out, rest = None, spots
    if not box[4] or mine[0] is None:
        return points.select("a_id", F.lit(None).cast(dict(right.dtypes)["b_id"]).alias("b_id"), F.lit(None).cast("double").alias("dist"), F.lit(1).alias("rank")).limit(0)
    wide = max(box[1], mine[1]) - min(box[0], mine[0]) + max(box[3], mine[3]) - min(box[2], mine[2])
    even = math.sqrt((box[1] - box[0]) * (box[3] - box[2]) * 4 * k / box[4])
    while 0 < even < size / 2:
        size, max_rounds = size / 2, max_rounds + 1
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("a_id").orderBy("dist", "b_id")
    for _ in range(max_rounds):
        last = size > wide
        # Few bytes make very many pairs, so the number of tasks is given.
        near = _with_cells(rest, size, 1).withColumnsRenamed({"x": "ax", "y": "ay"}).repartition(tasks, "_cx", "_cy")
        own = right.withColumns({"_cx": cell(F.col("bx"), size), "_cy": cell(F.col("by"), size)})
        found = near.join(own, ["_cx", "_cy"]).withColumn("dist", F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)))
        found = materialize(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("a_id", "b_id", "dist", "rank"), "near")
        settled = found.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
        settled = settled.filter(F.lit(last) | ((F.col("n") == k) & (F.col("far") <= size))).select("a_id")
        part = found.join(settled, "a_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if last:
            break
        rest = materialize(rest.join(settled, "a_id", "left_anti"), "points")
        if rest.isEmpty():
            break
        size *= 2
    else:
        raise RuntimeError(f"nearest neighbours not settled within {max_rounds} rounds: start with wider cells")
    hits = materialize(out.join(spots, "a_id").select("x", "y", "b_id", "dist", "rank"), "hits")
    return points.join(broadcast_if_small(hits, 500_000), ["x", "y"]).select("a_id", "b_id", "dist", "rank")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each row of left with the ``value`` of right's latest row of the same keys
    at or before it (null without one): one union and one window, no range join."""
    both = left.withColumns({"_value": F.lit(None).cast(dict(right.dtypes)[value]), "_left": F.lit(1)}).unionByName(
        right.select(*by, at, F.col(value).alias("_value"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).filter("_left = 1").drop("_value", "_left")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """(q_id, e_id, rank): the k nearest (Euclidean, to six decimals, ties by id) of
    vectors(id, embedding) for each of queries(id, embedding), the query itself left out.

    Queries are broadcast in blocks of about ``block``; each batch of vectors
    keeps its k best a query, so what is shuffled is k rows a query and batch."""
    spark = vectors.sparkSession
    ship_package(spark)
    blocks = max(1, -(-queries.count() // block))
    out = None
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").toPandas()
        ids, wanted = own["id"].to_numpy(), np.array([*own["embedding"]], float).reshape(len(own), -1)
        held = spark.sparkContext.broadcast((ids, wanted))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, wanted = held.value
            for batch in batches:
                if not len(ids):
                    continue
                v, names = np.array([*batch["embedding"]], float), batch["id"].to_numpy()
                for at in range(0, len(ids), 16):  # 16 x batch x dimension numbers at a time
                    q = wanted[at : at + 16]
                    dist = np.round(np.sqrt(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)), 6)
                    dist[ids[at : at + 16, None] == names[None, :]] = np.inf
                    near = np.lexsort((np.broadcast_to(names, dist.shape), dist), axis=1)[:, :k]
                    rows = np.repeat(np.arange(len(q)), near.shape[1])
                    found = dist[rows, near.ravel()]
                    ok = np.isfinite(found)
                    yield pd.DataFrame({"q_id": ids[at + rows][ok], "e_id": names[near.ravel()][ok], "dist": found[ok]})

        part = vectors.filter("embedding is not null").mapInPandas(best, f"q_id {dict(vectors.dtypes)['id']}, e_id {dict(vectors.dtypes)['id']}, dist double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("q_id").orderBy("dist", "e_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q_id", "e_id", "rank")


def segment_crossings(segments: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, x, y): where segments(id, x1, y1, x2, y2) cross or touch, each
    pair once; parallel ones are left out.

    Segments are dealt to the cells of their bounding boxes and meet there."""
    low, high = lambda c: F.least(f"{c}1", f"{c}2"), lambda c: F.greatest(f"{c}1", f"{c}2")
    dealt = segments.withColumn("_cx", F.explode(F.sequence(cell(low("x"), size), cell(high("x"), size))))
    dealt = dealt.withColumn("_cy", F.explode(F.sequence(cell(low("y"), size), cell(high("y"), size))))
    a = dealt.select("_cx", "_cy", *(F.col(c).alias(f"a_{c}") for c in segments.columns))
    b = dealt.select("_cx", "_cy", *(F.col(c).alias(f"b_{c}") for c in segments.columns))
    met = a.join(b, ["_cx", "_cy"]).filter("a_id < b_id").drop("_cx", "_cy").distinct()
    c = F.col
    dx, dy, ex, ey = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    cross = dx * ey - dy * ex
    gx, gy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    t, s = (gx * ey - gy * ex) / F.nullif(cross, F.lit(0.0)), (gx * dy - gy * dx) / F.nullif(cross, F.lit(0.0))
    hit = met.withColumns({"_t": t, "_s": s}).filter("_t between 0 and 1 and _s between 0 and 1")
    return hit.select("a_id", "b_id", (c("a_x1") + c("_t") * dx).alias("x"), (c("a_y1") + c("_t") * dy).alias("y"))
