"""Neighbourhoods of cells by weighted kernels, thresholds from histograms, and bodies of cells with their shape."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components
from geoloom.plans.materialize import materialize, ship_package

#: Cells along the side of a tile.
TILE = 256
#: The slopes of a surface along x and along y.
SOBEL_X = tuple((dx, dy, float(dx * (2 - abs(dy)))) for dx in (-1, 1) for dy in (-1, 0, 1))
SOBEL_Y = tuple((dy, dx, w) for dx, dy, w in SOBEL_X)

Kernel = Sequence[tuple[int, int, float]]


def annulus(inner: float, outer: float) -> Kernel:
    """Weight one for cells whose centres are ``inner`` to ``outer`` cells away."""
    r = int(outer)
    return tuple((dx, dy, 1.0) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if inner <= math.hypot(dx, dy) <= outer)


def decay(radius: float, rate: float) -> Kernel:
    """Weight exp(-rate * distance) up to ``radius`` cells."""
    return tuple((dx, dy, math.exp(-rate * math.hypot(dx, dy))) for dx, dy, _ in annulus(0, radius))


def _tiled(cells: DataFrame, reach: int, by: list[str], tile: int, made: dict, schema: str) -> DataFrame:
    """Applies ``made`` {column: function of a dense window} to each tile of cells(*by, cx,
    cy, value) with a rim of ``reach`` cells; a cell in the rim of others is sent to them too."""
    if reach > tile:
        raise ValueError(f"a kernel that reaches {reach} cells needs tiles of at least as many")
    ship_package(cells.sparkSession)
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    dealt = cells.select(*by, "cx", "cy", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).withColumn("_tx", F.explode(span("cx"))).withColumn("_ty", F.explode(span("cy")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(rows["_tx"].iloc[0]) * tile, int(rows["_ty"].iloc[0]) * tile
        x, y = rows["cx"].to_numpy() - x0, rows["cy"].to_numpy() - y0
        window = np.zeros((tile + 2 * reach, tile + 2 * reach))
        np.add.at(window, (x + reach, y + reach), rows["value"].to_numpy())
        own = (x >= 0) & (x < tile) & (y >= 0) & (y < tile)
        at = np.unique(np.stack([x[own], y[own]], axis=1), axis=0)
        out = {**{c: pd.Series([rows[c].iloc[0]] * len(at), dtype=rows[c].dtype) for c in by}, "cx": at[:, 0] + x0, "cy": at[:, 1] + y0}
        return pd.DataFrame(out | {name: fn(window)[at[:, 0], at[:, 1]] for name, fn in made.items()})

    return dealt.groupBy(*by, "_tx", "_ty").applyInPandas(run, schema)


def _schema(cells: DataFrame, by: list[str], names: Sequence[str]) -> str:
    kinds = dict(cells.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "cx long", "cy long", *(f"`{c}` double" for c in names)])


def convolved(cells: DataFrame, kernels: dict[str, Kernel], by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(*by, cx, cy, <name>...): for each of cells(*by, cx, cy, value) and each kernel the
    sum of weight * value over its neighbours (dx, dy); cells that aren't there, and
    null values, count as zero, a cell that repeats as the sum of its values.

    Cells are dealt to tiles with a rim as wide as the kernels reach, and a tile is
    shifted and added as a whole, so a kernel of thousands of cells sends no
    cell to thousands of others."""
    by, reach = list(by), max((max(abs(dx), abs(dy)) for k in kernels.values() for dx, dy, _ in k), default=0)

    def of(kernel: Kernel):
        def fn(window: np.ndarray) -> np.ndarray:
            out = np.zeros((tile, tile))
            for dx, dy, w in kernel:
                out += w * window[reach + dx : reach + dx + tile, reach + dy : reach + dy + tile]
            return out

        return fn

    return _tiled(cells, reach, by, tile, {name: of(k) for name, k in kernels.items()}, _schema(cells, by, list(kernels)))


def box_sums(cells: DataFrame, radius: int, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(*by, cx, cy, total): the sum over the square of cells up to ``radius`` away, from a
    summed-area table of the tile: four look-ups a cell, whatever the radius."""
    by, wide = list(by), 2 * radius + 1

    def fn(window: np.ndarray) -> np.ndarray:
        table = np.pad(window.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return table[wide : wide + tile, wide : wide + tile] - table[:tile, wide : wide + tile] - table[wide : wide + tile, :tile] + table[:tile, :tile]

    return _tiled(cells, radius, by, tile, {"total": fn}, _schema(cells, by, ["total"]))


def otsu(values: DataFrame, value: str = "value", bins: int = 256) -> DataFrame:
    """(threshold): the bound between two classes of values that differ most between
    them (the greatest variance between classes), from a histogram of ``bins``
    equal steps from the least value to the greatest; the least such bound. Null
    without two different values; null values don't count."""
    own = values.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = own.agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("high > low")
    step = (F.col("high") - F.col("low")) / bins
    counted = own.join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("v") - F.col("low")) / step), F.lit(bins - 1)).alias("bin"), "low", "high").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    mid = F.col("bin") + 0.5
    sums = counted.select("bin", "low", "high", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * mid).over(w).alias("s0"), F.sum("n").over(Window.partitionBy("low")).alias("n"), F.sum(F.col("n") * mid).over(Window.partitionBy("low")).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    split = sums.filter(F.col("n0") < F.col("n")).withColumn("between", F.round(F.col("n0") / F.col("n") * (n1 / F.col("n")) * gap * gap, 9))
    best = split.agg(F.min_by(F.struct("bin", "low", "high"), F.struct(-F.col("between"), "bin")).alias("b"))
    return best.select((F.col("b.low") + (F.col("b.bin") + 1) * (F.col("b.high") - F.col("b.low")) / bins).alias("threshold"))


def bodies(cells: DataFrame, corners: bool = True) -> DataFrame:
    """(body, cx, cy): cells(cx, cy) by the body that they make, named by its smallest
    cell ("cx:cy"); cells that touch at a corner belong together unless ``corners`` is false."""
    name = lambda x, y: F.concat_ws(":", x, y)
    own = materialize(cells.select("cx", "cy").distinct().withColumn("node", name("cx", "cy")), "cells")
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if corners else [])]
    sent = own.select(F.col("node").alias("u"), F.explode(F.array(*(F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a, b in steps))).alias("s")).select("u", "s.cx", "s.cy")
    parts = connected_components(sent.join(own, ["cx", "cy"]).select("u", F.col("node").alias("v")))
    return own.join(parts, "node", "left").select(F.coalesce("component", "node").alias("body"), "cx", "cy")


def body_shapes(found: DataFrame, size: float = 1.0) -> DataFrame:
    """(body, cells, area, x, y, major, minor, eccentricity) of bodies(body, cx, cy): the
    axes are those of the ellipse with the same second moments, in the unit of ``size``."""
    sums = found.groupBy("body").agg(F.count(F.lit(1)).alias("cells"), F.avg("cx").alias("x"), F.avg("cy").alias("y"), F.var_pop("cx").alias("_xx"), F.var_pop("cy").alias("_yy"), F.covar_pop("cx", "cy").alias("_xy"))
    a, b = F.col("_xx") + 1 / 12, F.col("_yy") + 1 / 12  # a cell has an extent of its own
    root = F.sqrt(F.pow(a - b, 2) + 4 * F.pow("_xy", 2))
    high, low = (a + b + root) / 2, F.greatest((a + b - root) / 2, F.lit(0.0))
    return sums.select("body", "cells", (F.col("cells") * size * size).alias("area"), ((F.col("x") + 0.5) * size).alias("x"), ((F.col("y") + 0.5) * size).alias("y"), (4 * F.sqrt(high) * size).alias("major"), (4 * F.sqrt(low) * size).alias("minor"), F.sqrt(F.greatest(1 - low / high, F.lit(0.0))).alias("eccentricity"))


def water(surface: DataFrame, size: float = 1.0, shore: int = 1, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(bodies, shore) of surface(cx, cy, <value>), a water index: bodies(body, cells, area,
    ..., eccentricity) of the cells above Otsu's bound, and shore(cx, cy), the
    surface's dry cells within ``shore`` cells (in a square) of the water's edge, where
    the slope of the mask is one or more."""
    bound = otsu(surface, value)
    mask = materialize(surface.join(F.broadcast(bound), how="left").select("cx", "cy", F.coalesce((F.col(value) > F.col("threshold")).cast("double"), F.lit(0.0)).alias("value")), "mask")
    slopes = convolved(mask, {"sx": SOBEL_X, "sy": SOBEL_Y})
    edge = materialize(slopes.select("cx", "cy", (F.hypot("sx", "sy") >= 1).cast("double").alias("value")), "edge")
    near = box_sums(edge, shore).filter("total > 0").select("cx", "cy")
    return body_shapes(bodies(mask.filter("value = 1")), size), near.join(mask.filter("value = 0").select("cx", "cy"), ["cx", "cy"])


def puga(cells: DataFrame, zones: DataFrame, radius: float, rates: Sequence[float] = (0.5, 1.0)) -> DataFrame:
    """(zone, plain, decay_1, ...): by zones(zone, cx, cy), the people around the average
    inhabitant: every cell's share of its zone's people times the people of the zone
    within ``radius`` cells, plain and falling off with the distance by each rate."""
    own = materialize(cells.select("cx", "cy", "value").join(zones, ["cx", "cy"]), "people")
    kernels = {"plain": annulus(0, radius), **{f"decay_{i}": decay(radius, r) for i, r in enumerate(rates, 1)}}
    around = convolved(own, kernels, ["zone"])
    total = own.groupBy("zone").agg(F.sum("value").alias("_all"))
    met = around.join(own.groupBy("zone", "cx", "cy").agg(F.sum("value").alias("_v")), ["zone", "cx", "cy"]).join(total, "zone")
    return met.groupBy("zone").agg(*(F.sum(F.col("_v") / F.nullif(F.col("_all"), F.lit(0.0)) * F.col(k)).alias(k) for k in kernels))
