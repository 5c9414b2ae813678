"""Grids as cell tables (cx, cy, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components


def zonal_stats(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone, n, total, low, high, mean) of cells(cx, cy, value) in zones(cx, cy, zone); -1 throughout for a zone without cells."""
    found = zones.join(cells, ["cx", "cy"], "left").groupBy("zone")
    stats = {"n": F.count("value"), "total": F.sum("value"), "low": F.min("value"), "high": F.max("value"), "mean": F.avg("value")}
    return found.agg(*(F.coalesce(v, F.lit(-1)).alias(k) if k != "n" else v.alias(k) for k, v in stats.items()))


def focal_sum(cells: DataFrame, radius: int = 1) -> DataFrame:
    """(cx, cy, focal): the sum of the values up to ``radius`` cells away, the cell itself included.

    Each value is sent to the cells it reaches and summed there (with map-side
    combine); only cells that exist are returned."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    sent = cells.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    sums = sent.groupBy((F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")).agg(F.sum("value").alias("focal"))
    return sums.join(cells.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")


def clusters(cells: DataFrame, least_value: float, least_total: float) -> DataFrame:
    """(cx, cy, cluster, total): 8-neighbour groups of cells above ``least_value`` whose values sum to ``least_total`` or more.

    A cluster is named by its smallest cell, as "cx:cy" padded."""
    name = F.format_string("%012d:%012d", F.col("cx") + 100_000_000_000, F.col("cy") + 100_000_000_000)
    own = cells.filter(F.col("value") > least_value).withColumn("node", name)
    span = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    side = own.withColumn("_s", F.explode(span)).select(F.col("node").alias("u"), (F.col("cx") + F.col("_s.a")).alias("cx"), (F.col("cy") + F.col("_s.b")).alias("cy"))
    edges = side.join(own.select("cx", "cy", F.col("node").alias("v")), ["cx", "cy"]).select("u", "v")
    named = own.join(connected_components(edges), "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    total = named.groupBy("cluster").agg(F.sum("value").alias("total")).filter(F.col("total") >= least_total)
    return named.join(total, "cluster").select("cx", "cy", "cluster", "total")


def jaccard(flags: DataFrame) -> DataFrame:
    """(jaccard): both / either of flags(a, b) with 0 and 1; -1 where neither occurs."""
    both, either = F.sum(F.col("a") * F.col("b")), F.sum(F.greatest("a", "b"))
    return flags.agg(F.when(either > 0, both / either).otherwise(F.lit(-1.0)).alias("jaccard"))


def kappa(flags: DataFrame) -> DataFrame:
    """(kappa): Cohen's kappa of two binary classifications a and b."""
    n, p = F.count(F.lit(1)), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    a, b = F.avg("a"), F.avg("b")
    e = a * b + (1 - a) * (1 - b)
    return flags.agg(F.when(e < 1, (p - e) / (1 - e)).alias("kappa"), n.alias("n"))


def cost_edges(cells: DataFrame) -> DataFrame:
    """(u, v, cost) between the 8 neighbours of a friction surface: the mean of
    both values times the step's length; nodes are "cx:cy". Feed it to
    shortest_paths for travel cost over a surface."""
    name = lambda a, b: F.concat_ws(":", a, b)
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    sent = cells.withColumn("_s", F.explode(steps)).select(
        name("cx", "cy").alias("u"), F.col("value").alias("_from"), (F.col("cx") + F.col("_s.a")).alias("cx"), (F.col("cy") + F.col("_s.b")).alias("cy"),
        F.when((F.col("_s.a") != 0) & (F.col("_s.b") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0).alias("_far"),
    )
    met = sent.join(cells, ["cx", "cy"])
    return met.select("u", name("cx", "cy").alias("v"), ((F.col("_from") + F.col("value")) / 2 * F.col("_far")).alias("cost"))


def expansion_index(old: DataFrame, new: DataFrame, radius: int = 1) -> DataFrame:
    """(patch, ring, lei): for each patch of new(patch, cx, cy), the cells of the
    ring within ``radius`` of it and the percentage of them in old(cx, cy)."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    near = new.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    near = near.select("patch", (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")).distinct()
    ring = near.join(new.select("patch", "cx", "cy").distinct(), ["patch", "cx", "cy"], "left_anti")
    hit = ring.join(old.select("cx", "cy").distinct().withColumn("_old", F.lit(1)), ["cx", "cy"], "left")
    return hit.groupBy("patch").agg(F.count(F.lit(1)).alias("ring"), (100 * F.count("_old") / F.count(F.lit(1))).alias("lei"))


def first_return(cells: DataFrame, years: list[int]) -> DataFrame:
    """``cells`` with first_return: the smallest of the columns y<year> whose value lies between 0 and 100; 0 without one."""
    hit = F.coalesce(*(F.when((F.col(f"y{y}") > 0) & (F.col(f"y{y}") < 100), y) for y in sorted(years)), F.lit(0))
    return cells.withColumn("first_return", hit)


def built_by_epoch(cells: DataFrame, codes: dict[int, int]) -> DataFrame:
    """(zone, built_<year>...): cells of each zone whose value reaches the code of the year, which later years have lower."""
    return cells.groupBy("zone").agg(*(F.sum((F.col("value") >= code).cast("int")).alias(f"built_{year}") for year, code in codes.items()))


def light_sums(cells: DataFrame, zones: DataFrame, floor: float) -> DataFrame:
    """(zone, urban_lights, rural_lights) of cells(zone, value, urban) from ``floor`` up; 0 for a zone without any."""
    kept = cells.filter(F.col("value") >= floor).groupBy("zone").agg(F.sum(F.when(F.col("urban"), F.col("value"))).alias("_u"), F.sum(F.when(~F.col("urban"), F.col("value"))).alias("_r"))
    return zones.join(kept, "zone", "left").select("zone", F.coalesce("_u", F.lit(0.0)).alias("urban_lights"), F.coalesce("_r", F.lit(0.0)).alias("rural_lights"))


def agglomerations(cities: DataFrame, tie: str) -> DataFrame:
    """(footprint, kind, main_city, pop, cities) of cities(footprint, city, pop)."""
    n = F.count(F.lit(1))
    return cities.groupBy("footprint").agg(
        F.when(n == 1, "city").otherwise("agglomeration").alias("kind"), F.max_by("city", F.struct("pop", tie)).alias("main_city"), F.sum("pop").alias("pop"), n.alias("cities")
    )


def masked_stats(cells: DataFrame, zones: DataFrame, mask: DataFrame, highest: float) -> DataFrame:
    """Zonal statistics of the cells in the mask(cx, cy) whose value doesn't exceed ``highest``."""
    return zonal_stats(cells.filter(F.col("value") <= highest).join(mask.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi"), zones)


def population_within(cells: DataFrame, zones: DataFrame, cuts: list[float]) -> DataFrame:
    """(zone, pop, within_<cut>..., share_<cut>..., beyond) of two-band cells(cx, cy, pop, seconds):
    people by travel time; cells without a time lie beyond every cut."""
    near = lambda c: F.coalesce(F.sum(F.when(F.col("seconds") <= c, F.col("pop"))), F.lit(0.0))
    total = F.coalesce(F.sum("pop"), F.lit(0.0))
    out = zones.join(cells, ["cx", "cy"]).groupBy("zone").agg(total.alias("pop"), *(near(c).alias(f"within_{c:g}") for c in cuts))
    shares = {f"share_{c:g}": F.col(f"within_{c:g}") / F.nullif(F.col("pop"), F.lit(0.0)) for c in cuts}
    return out.withColumns(shares).withColumn("beyond", F.col("pop") - F.col(f"within_{max(cuts):g}"))


def resample_nearest(cells: DataFrame, factor: float) -> DataFrame:
    """Cells of another grid, ``factor`` of the old ones wide: each takes the value of the old cell at its centre."""
    wide = F.lit(float(factor))
    box = cells.select(F.floor(F.col("cx") / wide).alias("nx"), F.floor(F.col("cy") / wide).alias("ny")).distinct()
    spot = box.select("nx", "ny", F.floor((F.col("nx") + 0.5) * wide).alias("cx"), F.floor((F.col("ny") + 0.5) * wide).alias("cy"))
    return spot.join(cells, ["cx", "cy"]).select(F.col("nx").alias("cx"), F.col("ny").alias("cy"), "value")


def sample_bilinear(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points(id, x, y), in cell units with values at cell centres, with value: the
    mean of the four cells around, by nearness, over those that exist."""
    x, y = F.col("x") - 0.5, F.col("y") - 0.5
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    four = points.select("id", F.floor(x).alias("bx"), F.floor(y).alias("by"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), F.explode(corners).alias("s"))
    side = lambda f, s: F.when(s == 1, f).otherwise(1 - f)
    four = four.select("id", (F.col("bx") + F.col("s.a")).alias("cx"), (F.col("by") + F.col("s.b")).alias("cy"), (side(F.col("fx"), F.col("s.a")) * side(F.col("fy"), F.col("s.b"))).alias("w"))
    met = four.join(cells, ["cx", "cy"]).groupBy("id").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("value"))
    return points.join(met, "id", "left")


def with_fallback(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(cx, cy, value) of all cells of both: the fine value where it is 0 or more, else the coarse one."""
    both = fine.join(coarse.withColumnRenamed("value", "_low"), ["cx", "cy"], "full")
    return both.select("cx", "cy", F.coalesce(F.when(F.col("value") >= 0, F.col("value")), F.col("_low")).alias("value"))


def mosaic(*parts: DataFrame) -> DataFrame:
    """(cx, cy, value) of the parts(cx, cy, value) laid over each other, the first on top."""
    every = None
    for k, p in enumerate(parts):
        one = p.select("cx", "cy", "value", F.lit(k).alias("_k"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("cx", "cy").agg(F.min_by("value", "_k").alias("value"))


def equal_patches(cells: DataFrame) -> DataFrame:
    """(cx, cy, value, patch): 4-neighbour groups of cells of one value, named by the smallest cell."""
    name = F.format_string("%012d:%012d", F.col("cx") + 100_000_000_000, F.col("cy") + 100_000_000_000)
    own = cells.withColumn("node", name)
    span = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0))))
    side = own.withColumn("_s", F.explode(span)).select(F.col("node").alias("u"), "value", (F.col("cx") + F.col("_s.a")).alias("cx"), (F.col("cy") + F.col("_s.b")).alias("cy"))
    edges = side.join(own.select("cx", "cy", "value", F.col("node").alias("v")), ["cx", "cy", "value"]).select("u", "v")
    return own.join(connected_components(edges), "node", "left").select("cx", "cy", "value", F.coalesce("component", "node").alias("patch"))


def smooth(cells: DataFrame, settled: int = 16, rounds: int = 50) -> DataFrame:
    """A majority filter over the 3 x 3 cells of a 0/1 surface, repeated until at most
    ``settled`` cells change or for ``rounds`` rounds; a tie keeps the cell."""
    from geoloom.plans.materialize import materialize

    span, now = F.sequence(F.lit(-1), F.lit(1)), cells.select("cx", "cy", "value")
    for _ in range(rounds):
        sent = now.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
        votes = sent.groupBy((F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")).agg(F.sum("value").alias("_ones"), F.count(F.lit(1)).alias("_all"))
        new = F.when(2 * F.col("_ones") > F.col("_all"), 1).when(2 * F.col("_ones") < F.col("_all"), 0).otherwise(F.col("value"))
        after = materialize(now.join(votes, ["cx", "cy"]).select("cx", "cy", new.alias("new"), (new != F.col("value")).alias("moved")), "smooth")
        now = after.select("cx", "cy", F.col("new").alias("value"))
        if after.filter("moved").count() <= settled:
            break
    return now
