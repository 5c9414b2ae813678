"""Accessibility and demand on long origin-destination tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.materialize import materialize

# The default decay rates of gravity access.
DECAYS = (0.01, 0.005, 0.001, 0.0007701635, 0.0003850818, 0.0001925409, 0.0000962704, 0.0000385082, 0.00001)


def gravity(od: DataFrame, decays: tuple[float, ...] = DECAYS) -> DataFrame:
    """(o, decay, access) = sum of w_o * w_d * exp(-decay * cost) over od(o, d, cost, w_o, w_d)."""
    each = od.sparkSession.createDataFrame([(float(x),) for x in decays], "decay double")
    term = F.col("w_o") * F.col("w_d") * F.exp(-F.col("decay") * F.col("cost"))
    return od.crossJoin(F.broadcast(each)).groupBy("o", "decay").agg(F.sum(term).alias("access"))


def market_access(od: DataFrame, cutoff: float) -> DataFrame:
    """(o, access) = sum of w_d / cost over destinations within the cutoff; 0 without any."""
    term = F.when((F.col("cost") <= cutoff) & (F.col("cost") > 0), F.col("w_d") / F.col("cost"))
    return od.groupBy("o").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("access"))


def gravity_demand(od: DataFrame, beta: float = 1.0, top: float = 100.0) -> DataFrame:
    """(o, d, trips): w_o * w_d * exp(-beta * cost / max cost), scaled so that the largest is ``top``, rounded up; none from a place to itself."""
    peak = od.agg(F.max("cost").alias("_most"))
    raw = od.crossJoin(F.broadcast(peak)).withColumn("_raw", F.when(F.col("o") == F.col("d"), 0.0).otherwise(F.col("w_o") * F.col("w_d") * F.exp(-beta * F.col("cost") / F.col("_most"))))
    high = raw.agg(F.max("_raw").alias("_high"))
    return raw.crossJoin(F.broadcast(high)).select("o", "d", F.ceil(F.col("_raw") / F.col("_high") * top).cast("long").alias("trips"))


def furness(cells: DataFrame, rounds: int = 10, least: float = 0.1) -> DataFrame:
    """(o, d, flow): doubly constrained distribution of cells(o, d, weight, production, attraction).

    Rows and columns are balanced in turn, ``rounds`` times; flows below
    ``least`` become 0."""
    now = cells.select("o", "d", "production", "attraction", F.col("weight").cast("double").alias("flow"))
    for _ in range(rounds):
        rows = now.groupBy("o").agg(F.sum("flow").alias("_s"))
        now = now.join(rows, "o").withColumn("flow", F.when(F.col("_s") > 0, F.col("flow") * F.col("production") / F.col("_s")).otherwise(0.0)).drop("_s")
        columns = now.groupBy("d").agg(F.sum("flow").alias("_s"))
        now = now.join(columns, "d").withColumn("flow", F.when(F.col("_s") > 0, F.col("flow") * F.col("attraction") / F.col("_s")).otherwise(0.0)).drop("_s")
        now = materialize(now, "furness")
    return now.select("o", "d", F.when(F.col("flow") < least, 0.0).otherwise(F.col("flow")).alias("flow"))


def nearest(od: DataFrame) -> DataFrame:
    """(o, d, cost) of each origin's nearest destination, ties by the smaller d."""
    return od.filter("cost is not null").groupBy("o").agg(F.min(F.struct("cost", "d")).alias("x")).select("o", "x.d", "x.cost")


def catchment(od: DataFrame, cutoff: float) -> DataFrame:
    """(d, total, only, share): weight of the origins within the cutoff (above 0), of those that reach d alone, and their ratio."""
    near = od.filter((F.col("cost") > 0) & (F.col("cost") < cutoff)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("o")))
    out = near.groupBy("d").agg(F.sum("w_o").alias("total"), F.coalesce(F.sum(F.when(F.col("_n") == 1, F.col("w_o"))), F.lit(0)).alias("only"))
    return out.withColumn("share", F.col("only") / F.col("total"))


def within_thresholds(od: DataFrame, cuts: list[float], weight: str) -> DataFrame:
    """One column within_<cut> a threshold: cumulative weight reached below it."""
    return od.groupBy("o").agg(*(F.coalesce(F.sum(F.when(F.col("cost") < c, F.col(weight))), F.lit(0)).alias(f"within_{c:g}") for c in cuts))


def with_walks(od: DataFrame, legs: DataFrame, direct: DataFrame) -> DataFrame:
    """(o, net, best, mode): the least cost to any destination of od(o, d, cost), the
    walk of legs(d, walk) at its end included, against the walk of direct(o, direct)
    all the way; a destination without a leg costs no walk."""
    total = od.join(legs, "d", "left").groupBy("o").agg(F.min(F.col("cost") + F.coalesce("walk", F.lit(0.0))).alias("net"))
    both = total.join(direct, "o", "full")
    mode = F.when(F.col("net").isNull() | (F.col("direct") <= F.col("net")), "walk").otherwise("net")
    return both.select("o", "net", F.least("net", "direct").alias("best"), mode.alias("mode"))


def nearest_in_region(od: DataFrame, regions: DataFrame) -> DataFrame:
    """(o, d, cost) of the nearest destination that lies in the origin's region, by regions(node, region)."""
    at = lambda end: regions.select(F.col("node").alias(end), F.col("region").alias(f"_{end}"))
    return nearest(od.join(at("o"), "o").join(at("d"), "d").filter("_o = _d").select("o", "d", "cost"))
