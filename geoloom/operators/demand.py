"""Demand, capacity and disruption measures on networks and long OD tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import routing


def productions_attractions(zones: DataFrame, produced: str, attracted: str) -> DataFrame:
    """``zones`` with attraction: a missing value counts as the mean, and all are scaled to the sum of ``produced``."""
    totals = zones.agg(F.avg(attracted).alias("_mean"), F.sum(produced).alias("_made"))
    filled = zones.crossJoin(F.broadcast(totals)).withColumn("_a", F.coalesce(attracted, "_mean"))
    whole = filled.agg(F.sum("_a").alias("_all"))
    return filled.crossJoin(F.broadcast(whole)).withColumn("attraction", F.col("_a") / F.col("_all") * F.col("_made")).select(*zones.columns, "attraction")


def deterrence_flows(od: DataFrame, deterrence: Callable[[Column], Column], production: str, attraction: str) -> DataFrame:
    """(o, d, flow): each origin's production shared over its destinations by attraction times deterrence(cost)."""
    raw = F.when(F.col("o") == F.col("d"), 0.0).otherwise(F.col(attraction) * deterrence(F.col("cost")))
    df = od.withColumn("_raw", raw)
    total = F.sum("_raw").over(Window.partitionBy("o"))
    return df.select("o", "d", F.when(total > 0, F.col(production) * F.col("_raw") / total).otherwise(0.0).alias("flow"))


def combine_products(flows: DataFrame, factors: DataFrame) -> DataFrame:
    """(o, d, flow): flows(product, o, d, flow) summed with factors(product, factor)."""
    return flows.join(F.broadcast(factors), "product").groupBy("o", "d").agg(F.sum(F.col("flow") * F.col("factor")).alias("flow"))


def probit_assignment(edges: DataFrame, demand: DataFrame, rounds: int, spread: float, seed: int) -> DataFrame:
    """(u, v, flow): the mean all-or-nothing flow over ``rounds`` draws of the edge
    costs, each normal about its mean with a standard deviation of ``spread``
    times the mean (never below zero). The draws are made of hashes of edge and
    round, so they are the same however the rows are dealt out."""
    spark = edges.sparkSession
    part = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "u", "v", "s"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(part(1))) * F.cos(2 * F.pi() * part(2))
    drawn = edges.select("u", "v", "cost").crossJoin(F.broadcast(spark.range(rounds).withColumnRenamed("id", "s")))
    drawn = drawn.withColumn("cost", F.greatest(F.col("cost") * (1 + spread * normal), F.lit(0.0)))
    sources = demand.select("o").distinct().crossJoin(F.broadcast(spark.range(rounds).withColumnRenamed("id", "s")))
    paths = routing.shortest_paths(drawn, sources, keys=("s",))
    # A round's origins are told apart by a combined name, so all rounds walk back together.
    name = lambda end: F.concat_ws("|", F.col("s"), F.col(end))
    coded = paths.select(name("o").alias("o"), name("node").alias("node"), F.when(F.col("prev").isNotNull(), name("prev")).alias("prev"))
    wanted = demand.crossJoin(F.broadcast(spark.range(rounds).withColumnRenamed("id", "s"))).select(name("o").alias("o"), name("d").alias("d"), "flow")
    flows = routing.assign_flows(coded, wanted)
    kind = dict(edges.dtypes)["u"]
    bare = lambda end: F.substring_index(end, "|", -1).cast(kind)
    return flows.groupBy(bare("u").alias("u"), bare("v").alias("v")).agg((F.sum("flow") / rounds).alias("flow"))


def betweenness(flows: DataFrame, demand: DataFrame) -> DataFrame:
    """``flows`` with betweenness: the share of all demand that uses the edge."""
    return flows.crossJoin(F.broadcast(demand.agg(F.sum("flow").alias("_all")))).withColumn("betweenness", F.col("flow") / F.col("_all")).drop("_all")


def disruption_summary(base: DataFrame, broken: DataFrame, demand: DataFrame, slow: float = 0.3, elasticities: tuple[float, ...] = (-0.15, -0.36)) -> DataFrame:
    """(scenario, isolated, delay, slowed, loss_<e>...) of broken(scenario, o, d, cost).

    ``isolated`` is the share of trips without a path, ``delay`` the mean rise of
    cost of the others, ``slowed`` the share delayed by over ``slow``, and each
    loss the consumer surplus lost at that elasticity."""
    df = broken.withColumnRenamed("cost", "_now").join(base.withColumnRenamed("cost", "_was"), ["o", "d"]).join(demand, ["o", "d"])
    cut, trips = F.col("_now").isNull(), F.col("flow")
    rise = (F.col("_now") - F.col("_was")) / F.col("_was")
    losses = [F.sum(F.when(~cut, trips * (F.col("_now") - F.col("_was")) * (1 + e * rise / 2))).alias(f"loss_{abs(e):g}") for e in elasticities]
    open_trips = F.sum(F.when(~cut, trips))
    return df.groupBy("scenario").agg(
        (F.sum(F.when(cut, trips).otherwise(0)) / F.sum(trips)).alias("isolated"),
        (F.sum(F.when(~cut, trips * rise)) / open_trips).alias("delay"),
        (F.sum(F.when(~cut & (rise > slow), trips).otherwise(0)) / F.sum(trips)).alias("slowed"),
        *losses,
    )


def criticality_summary(broken: DataFrame, demand: DataFrame, cost_weight: float = 0.5) -> DataFrame:
    """(edge_u, edge_v, extra, isolated, score) of break_edges' rows: demand-weighted
    extra cost and cut trips, each scaled to 0..1 over the edges, then mixed."""
    df = broken.join(demand, ["o", "d"])
    by = df.groupBy("edge_u", "edge_v").agg(
        F.coalesce(F.sum((F.col("cost") - F.col("base")) * F.col("flow")), F.lit(0.0)).alias("extra"),
        F.sum(F.when(F.col("cost").isNull(), F.col("flow")).otherwise(0.0)).alias("isolated"),
    )
    ends = by.agg(*(f(c).alias(f"_{n}_{c}") for c in ("extra", "isolated") for n, f in (("lo", F.min), ("hi", F.max))))
    unit = lambda c: F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)), F.lit(0.0))
    score = cost_weight * unit("extra") + (1 - cost_weight) * unit("isolated")
    return by.crossJoin(F.broadcast(ends)).select("edge_u", "edge_v", "extra", "isolated", score.alias("score"))
