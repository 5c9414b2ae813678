"""Facility location on long cost tables, by greedy choice and exchange."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.materialize import materialize


def _pick(scores: DataFrame) -> tuple | None:
    return scores.orderBy(F.desc("score"), "d").first()


def max_cover(od: DataFrame, p: int, cutoff: float) -> DataFrame:
    """(pick, d, gained): up to p facilities of od(o, d, cost, w_o), each the one
    that covers the most weight not covered so far (ties: smaller d)."""
    spark = od.sparkSession
    left = materialize(od.filter(F.col("cost") <= cutoff).select("o", "d", "w_o").distinct(), "cover")
    chosen = []
    for k in range(p):
        best = _pick(left.groupBy("d").agg(F.sum("w_o").alias("score")))
        if best is None or not best["score"]:
            break
        chosen.append((k, best["d"], float(best["score"])))
        done = left.filter(F.col("d") == F.lit(best["d"])).select("o")
        left = materialize(left.join(done, "o", "left_anti"), "cover")
    return spark.createDataFrame(chosen, f"pick int, d {dict(od.dtypes)['d']}, gained double")


def set_cover(od: DataFrame, cutoff: float, share: float = 1.0) -> DataFrame:
    """As max_cover, until ``share`` of the coverable weight is covered."""
    total = od.filter(F.col("cost") <= cutoff).select("o", "w_o").distinct().agg(F.sum("w_o")).first()[0] or 0.0
    spark, left, chosen, got = od.sparkSession, materialize(od.filter(F.col("cost") <= cutoff).select("o", "d", "w_o").distinct(), "cover"), [], 0.0
    while got < share * total - 1e-9:
        best = _pick(left.groupBy("d").agg(F.sum("w_o").alias("score")))
        if best is None:
            break
        chosen.append((len(chosen), best["d"], float(best["score"])))
        got += float(best["score"])
        left = materialize(left.join(left.filter(F.col("d") == F.lit(best["d"])).select("o"), "o", "left_anti"), "cover")
    return spark.createDataFrame(chosen, f"pick int, d {dict(od.dtypes)['d']}, gained double")


def _best_of_all(od: DataFrame, sites: list, p: int, forced: Sequence = ()) -> list:
    """The cheapest of all choices of p sites with the forced ones among them; choices that leave an origin out lose to those that don't."""
    free = [d for d in sites if d not in forced]
    choices = [(k, d) for k, own in enumerate(combinations(free, p - len(forced))) for d in sorted([*forced, *own])]
    table = od.sparkSession.createDataFrame(choices, f"k long, d {dict(od.dtypes)['d']}")
    served = od.join(F.broadcast(table), "d").groupBy("k", "o").agg(F.min("c").alias("c"))
    best = served.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("n"), F.round("c", 9), "k").first()
    return [d for k, d in choices if k == best["k"]]


def _gains(od: DataFrame, kept: list) -> DataFrame:
    """(d, new, more): what each site outside ``kept`` adds to it: origins served
    for the first time, and cost (theirs, less what the others save)."""
    now = od.filter(F.col("d").isin(kept)).groupBy("o").agg(F.min("c").alias("best"))
    own = od.filter(~F.col("d").isin(kept)).join(now, "o", "left")
    more = F.when(F.col("best").isNull(), F.col("c")).otherwise(F.least("best", "c") - F.col("best"))
    return own.groupBy("d").agg(F.sum(F.col("best").isNull().cast("long")).alias("new"), F.sum(more).alias("more"))


def _value(od: DataFrame, sites: list) -> tuple[int, float]:
    """Origins served by the sites, and their cost."""
    row = od.filter(F.col("d").isin(sites)).groupBy("o").agg(F.min("c").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).first()
    return row["n"], row["c"] or 0.0


def p_median_method(sites: int, p: int, most_choices: int = 5_000) -> str:
    """The method that :func:`p_median` takes by itself for so many sites."""
    return "exact" if sites >= p and comb(sites, p) <= most_choices else "exchange"


def capacitated(od: DataFrame, chosen: DataFrame, capacities: DataFrame) -> DataFrame:
    """(o, d, cost) of origins served by the chosen(d) sites within capacities(d, cap):
    deferred acceptance by cost. Each origin asks its nearest site; a site keeps
    the nearest that fit into its capacity, weight after weight, and the rest ask
    their next one. An origin that fits nowhere has no row."""
    left = materialize(od.join(chosen.select("d"), "d", "left_semi").filter("cost is not null").select("o", "d", "cost", "w_o"), "asked")
    while True:
        first = left.groupBy("o").agg(F.min(F.struct("cost", "d")).alias("x")).select("o", F.col("x.d").alias("d"))
        asked = left.join(first, ["o", "d"])
        load = F.sum("w_o").over(Window.partitionBy("d").orderBy("cost", "o").rowsBetween(Window.unboundedPreceding, 0))
        judged = materialize(asked.withColumn("load", load).join(capacities, "d"), "judged")
        over = judged.filter("load > cap").select("o", "d")
        if over.isEmpty():
            return judged.select("o", "d", "cost")
        left = materialize(left.join(over, ["o", "d"], "left_anti"), "asked")


def p_median(od: DataFrame, p: int, rounds: int | None = None, most_choices: int = 5_000, method: str = "auto", forced: Sequence = ()) -> DataFrame:
    """(d): p facilities, the ``forced`` (existing) ones among them, with a small sum of
    w_o * cost to the nearest.

    Sets that serve more origins come before sets that serve fewer, then the
    cheaper. Method "exact" prices all choices of sites, in one grouped join, and
    takes the best (ties: the first in order). Method "exchange" chooses greedily,
    then swaps until no swap helps (or for ``rounds`` rounds, if given); the
    swaps of a site are priced in one grouped pass over the table, and the result
    need not be the best. "auto" is exact up to ``most_choices`` choices and
    exchange beyond; :func:`p_median_method` tells which."""
    if method not in ("auto", "exact", "exchange"):
        raise ValueError(f"no such method: {method}")
    forced = sorted(set(forced))
    if len(forced) > p:
        raise ValueError(f"{len(forced)} forced sites are more than {p}")
    spark = od.sparkSession
    od = od.filter("cost is not null").select("o", "d", (F.col("cost") * F.col("w_o")).alias("c"))
    od = materialize(od.groupBy("o", "d").agg(F.min("c").alias("c")), "median")
    n = od.select("d").distinct().count()
    if method == "exact" or (method == "auto" and p_median_method(n - len(forced), p - len(forced), most_choices) == "exact"):
        sites = sorted(r["d"] for r in od.select("d").distinct().collect())
        return spark.createDataFrame([(x,) for x in _best_of_all(od, sites, p, forced)], f"d {dict(od.dtypes)['d']}")
    order = (F.desc("new"), F.round("more", 9), "d")
    chosen: list = list(forced)
    for _ in range(p - len(forced)):
        best = _gains(od, chosen).orderBy(*order).first()
        if best is None:
            break
        chosen.append(best["d"])
    done = 0
    while chosen and (rounds is None or done < rounds):
        done += 1
        served, cost = _value(od, chosen)
        swaps = []
        for gone in (x for x in chosen if x not in forced):
            kept = [x for x in chosen if x != gone]
            top = _gains(od, kept).filter(F.col("d") != F.lit(gone)).orderBy(*order).first()
            if top is not None:
                n_kept, c_kept = _value(od, kept)
                swaps.append((-(n_kept + top["new"]), c_kept + top["more"], gone, top["d"]))
        if not swaps:
            break
        left, price, gone, come = min(swaps)
        if (left, price) >= (-served, cost - 1e-9 * max(1.0, abs(cost))):
            break
        chosen[chosen.index(gone)] = come
    return spark.createDataFrame([(x,) for x in sorted(chosen)], f"d {dict(od.dtypes)['d']}")


def p_median_bound(od: DataFrame, p: int, rounds: int = 60, forced: Sequence = (), close: float = 1e-4) -> DataFrame:
    """One row (lower, upper, gap, sites): no choice of p facilities of od(o, d, cost, w_o),
    the ``forced`` ones among them, costs less than ``lower``; ``sites`` cost ``upper``;
    gap is their difference as a share of ``upper``.

    Lagrangian relaxation: every origin has a price for being served; a site is
    worth what it saves over those prices, the p most worth are opened, and that
    choice's value bounds all others' from below. Prices move along the
    subgradient (up where nobody serves an origin, down where several do) by
    steps that shorten when the bound stands still, until bounds meet to within
    ``close`` or ``rounds`` end. A round is one grouped pass over the long table for
    the worth of sites and one over the rows of the opened ones. ``upper`` (and
    gap) is null while no choice met serves every origin."""
    spark, forced = od.sparkSession, sorted(set(forced))
    kind = dict(od.dtypes)["d"]
    od = od.filter("cost is not null").select("o", "d", (F.col("cost") * F.col("w_o")).cast("double").alias("c"))
    od = materialize(od.groupBy("o", "d").agg(F.min("c").alias("c")), "median")
    # A first price: the second nearest site's cost.
    two = F.slice(F.array_sort(F.collect_list("c")), 1, 2)
    near = od.withColumn("_n", F.row_number().over(Window.partitionBy("o").orderBy("c", "d"))).filter("_n <= 2")
    price = materialize(near.groupBy("o").agg(F.element_at(two, -1).alias("price")), "price")
    origins, lower, upper, best, scale, still = price.count(), float("-inf"), None, [], 2.0, 0
    for _ in range(rounds if origins else 0):
        worth = od.join(price, "o").groupBy("d").agg(F.sum(F.least(F.lit(0.0), F.col("c") - F.col("price"))).alias("worth"))
        top = worth.withColumn("_f", ~F.col("d").isin(forced)).orderBy("_f", "worth", "d").limit(p).collect()
        chosen = [r["d"] for r in top]
        served = od.filter(F.col("d").isin(chosen)).join(price, "o").groupBy("o").agg(F.min("c").alias("c"), F.sum((F.col("c") < F.col("price")).cast("long")).alias("n"))
        now = materialize(price.join(served, "o", "left").withColumn("up", 1 - F.coalesce("n", F.lit(0))), "served")
        row = now.agg(F.sum("price").alias("prices"), F.sum("c").alias("cost"), F.count("c").alias("met"), F.sum(F.pow("up", 2)).alias("norm")).first()
        bound = row["prices"] + sum(r["worth"] for r in top)
        if row["met"] == origins and (upper is None or row["cost"] < upper):
            upper, best = row["cost"], sorted(chosen)
        still = 0 if bound > lower + 1e-9 * max(1.0, abs(lower) if lower > float("-inf") else 1.0) else still + 1
        lower = max(lower, bound)
        if not row["norm"] or (upper is not None and upper - lower <= close * abs(upper)):
            break
        if still == 4:
            scale, still = scale / 2, 0
        goal = upper if upper is not None else lower + 0.1 * abs(lower) + 1.0
        step = scale * max(goal - bound, 1e-9) / row["norm"]
        price = now.select("o", (F.col("price") + F.lit(step) * F.col("up")).alias("price"))
        price = materialize(price, "price")
    lower = None if lower == float("-inf") else lower if upper is None else min(lower, upper)
    gap = None if upper is None else (upper - lower) / upper if upper else 0.0
    return spark.createDataFrame([(lower, upper, gap, best)], f"lower double, upper double, gap double, sites array<{kind}>")
