"""Figures of a city's form: convex hulls that merge, coverage, exact distances, and equal-area growth."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import ring_area
from geoloom.operators.polygons import points_in_polygons
from geoloom.plans.materialize import broadcast_if_small, materialize, ship_package


def hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (rows of x, y), counter-clockwise from
    the leftmost; points on its sides are left out."""
    points = np.unique(xy, axis=0)
    if len(points) < 3:
        return points

    def half(rows: Iterator) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(points.tolist()), half(points[::-1].tolist())
    return np.array(lower[:-1] + upper[:-1])


def convex_hulls(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, area, ring): the convex hull of each group of points(*by, x, y), closed and
    counter-clockwise; null coordinates are passed over, one or two points give no area.

    Tasks hand on the corners of the hull of their own points of a group, and the
    hull of those is the group's, so no group's points meet in one task."""
    by = list(by)
    ship_package(points.sparkSession)
    own = points.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    kinds = dict(own.dtypes)
    lead = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]:
                key = key if isinstance(key, tuple) else (key,)
                now = rows[["x", "y"]].to_numpy()
                name = tuple(None if pd.isna(k) else k for k in key)
                held[name] = hull(np.concatenate([held[name], now]) if name in held else now)
        for name, corners in held.items():
            yield pd.DataFrame({**{c: [v] * len(corners) for c, v in zip(by, name, strict=True)}, "x": corners[:, 0], "y": corners[:, 1]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        corners = hull(rows[["x", "y"]].to_numpy())
        ring = [{"x": x, "y": y} for x, y in corners.tolist()]
        return pd.DataFrame([[*(rows[c].iloc[0] for c in by), ring + ring[:1]]], columns=[*by, "ring"])

    parts = own.mapInPandas(partial, f"{lead}x double, y double")
    rings = parts.groupBy(*by).applyInPandas(merged, f"{lead}ring array<struct<x:double,y:double>>")
    return rings.select(*by, ring_area(F.col("ring")).alias("area"), "ring")


def coverage(built: DataFrame, unbuildable: DataFrame, by: Sequence[str], size: float = 1.0) -> DataFrame:
    """(*by, built, hull, unbuildable, coverage): of built(*by, cx, cy), cells ``size``
    wide, the share of their convex hull without the cells of unbuildable(cx, cy)
    whose centres lie in it. Repeated cells count once; null without any ground."""
    by = list(by)
    cells = built.select(*by, "cx", "cy").distinct()
    # Only the ends of each column of cells can be corners of the hull.
    ends = cells.groupBy(*by, "cx").agg(F.min("cy").alias("low"), (F.max("cy") + 1).alias("high"))
    corners = ends.select(*by, F.explode(F.array(*(F.struct((F.col("cx") + i).alias("x"), F.col(c).alias("y")) for i in (0, 1) for c in ("low", "high")))).alias("p"))
    hulls = materialize(convex_hulls(corners.select(*by, (F.col("p.x") * size).alias("x"), (F.col("p.y") * size).alias("y")), by).withColumn("poly_id", F.monotonically_increasing_id()), "hulls")
    bare = unbuildable.select("cx", "cy").distinct().select(((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    inside = points_in_polygons(bare, hulls.select("poly_id", "ring"), size).groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg((F.count(F.lit(1)) * (size * size)).alias("built"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = hulls.join(inside, "poly_id", "left").join(whole, same).withColumn("unbuildable", F.coalesce(F.col("n") * (size * size), F.lit(0.0)))
    return out.select(*by, "built", F.col("area").alias("hull"), "unbuildable", (F.col("built") / F.nullif(F.col("area") - F.col("unbuildable"), F.lit(0.0))).alias("coverage"))


def row_distances(x: np.ndarray, up: np.ndarray, first: int, last: int) -> np.ndarray:
    """For the cells first..last of a row, the least (x - x_i)^2 + up_i: the lower
    envelope of one parabola a column, whose order along the row is kept on a stack."""
    x, up = x.astype(float), up.astype(float)
    kept: list[int] = []
    starts: list[float] = []
    for i in range(len(x)):
        at = -math.inf
        while kept:
            j = kept[-1]
            at = ((up[i] + x[i] ** 2) - (up[j] + x[j] ** 2)) / (2 * (x[i] - x[j]))
            if at > starts[-1]:
                break
            kept.pop()
            starts.pop()
            at = -math.inf
        kept.append(i)
        starts.append(at)
    cells = np.arange(first, last + 1)
    who = np.array(kept)[np.searchsorted(np.array(starts), cells, "left").clip(1) - 1]
    return ((cells - x[who]) ** 2 + up[who]).astype(np.int64)


def reach_of(n: F.Column) -> F.Column:
    """Cells within this distance of n cells are at least as many again: of all shapes a disc needs the widest ring."""
    return (F.ceil(F.sqrt(n.cast("double")) * ((math.sqrt(2) - 1) / math.sqrt(math.pi))) + 2).cast("long")


def distances(built: DataFrame, by: Sequence[str], reach: F.Column) -> DataFrame:
    """(*by, cx, cy, d2): the squared distance of every cell to the nearest of its
    group's built(*by, cx, cy), for those outside within ``reach`` (of ``n``, the
    group's cells).

    Exact in two steps: up and down the columns to the nearest built cell, then
    along each row the lower envelope of those (:func:`row_distances`), a row of a
    group at a time."""
    by = list(by)
    cells = materialize(built.select(*by, "cx", "cy").distinct(), "cells")
    kinds = dict(cells.dtypes)
    n = cells.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("_west"), F.max("cx").alias("_east")).withColumn("reach", reach)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # A column's cells look to the next built one below and above; only the gaps' cells within reach are written.
    w = Window.partitionBy(*by, "cx").orderBy("cy")
    gaps = cells.withColumn("_down", F.lag("cy").over(w)).withColumn("_up", F.lead("cy").over(w)).join(broadcast_if_small(n, 1_000_000), same)
    below = F.sequence(F.greatest(F.col("cy") - F.col("reach"), F.coalesce(F.floor((F.col("cy") + F.col("_down")) / 2), F.col("cy") - F.col("reach"))), F.col("cy"))
    above = F.sequence(F.col("cy"), F.least(F.col("cy") + F.col("reach"), F.coalesce(F.ceil((F.col("cy") + F.col("_up")) / 2), F.col("cy") + F.col("reach"))))
    column = gaps.withColumn("row", F.explode(F.array_union(below, above))).groupBy(*by, "cx", "row").agg(F.min(F.pow(F.col("row") - F.col("cy"), 2).cast("long")).alias("up"), F.first("reach").alias("reach"), F.first("_west").alias("_west"), F.first("_east").alias("_east"))
    lead = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def envelope(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cx")
        reach, west, east = (int(rows[c].iloc[0]) for c in ("reach", "_west", "_east"))
        d2 = row_distances(rows["cx"].to_numpy(), rows["up"].to_numpy(), west - reach, east + reach)
        at = np.flatnonzero((d2 > 0) & (d2 <= reach * reach))
        return pd.DataFrame({**{c: pd.Series([rows[c].iloc[0]] * len(at), dtype=rows[c].dtype) for c in by}, "cx": at + west - reach, "cy": int(rows["row"].iloc[0]), "d2": d2[at]})

    ship_package(built.sparkSession)
    return column.groupBy(*by, "row").applyInPandas(envelope, f"{lead}cx long, cy long, d2 long")


def grown(built: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, cx, cy, d2): the ring of cells around each group's built(*by, cx, cy) that
    holds at least as many cells: all within the smallest distance that does."""
    by = list(by)
    n = built.select(*by, "cx", "cy").distinct().groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count(F.lit(1)).alias("cells_built"))
    far = materialize(distances(built, by, reach_of(F.col("n"))), "distances")
    counts = far.groupBy(*by, "d2").agg(F.count(F.lit(1)).alias("cells_within"))
    counts = counts.withColumn("cells_within", F.sum("cells_within").over(Window.partitionBy(*by).orderBy("d2")))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    edge = counts.join(n, same).filter("cells_within >= cells_built").groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("d2").alias("_edge"))
    return far.join(broadcast_if_small(materialize(edge, "edge"), 1_000_000), same).filter("d2 <= _edge").select(*by, "cx", "cy", "d2")


def expandability(built: DataFrame, unbuildable: DataFrame, by: Sequence[str], feature: Sequence[str]) -> DataFrame:
    """(*by, built, ring, buildable, expandability): every feature (by and ``feature``) of
    built(*by, *feature, cx, cy) grows by a ring of its own area; of all the rings of
    a city, laid together, the share of the built area that isn't in
    unbuildable(cx, cy). A ring may lie over another feature."""
    by, parts = list(by), [*by, *feature]
    ring = grown(built, parts).select(*by, "cx", "cy").distinct()
    bare = unbuildable.select("cx", "cy").distinct().withColumn("_bare", F.lit(1))
    rings = ring.join(bare, ["cx", "cy"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("ring"), F.sum(F.when(F.col("_bare").isNull(), 1).otherwise(0)).alias("buildable"))
    whole = built.select(*parts, "cx", "cy").distinct().groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count(F.lit(1)).alias("built"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rings.join(whole, same).select(*by, "built", "ring", "buildable", (F.col("buildable") / F.col("built")).alias("expandability"))
