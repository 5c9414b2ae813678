"""Monte-Carlo disruption: many networks with some edges out of use, searched by repairing path trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ranks import running
from geoloom.operators.routing import shortest_paths
from geoloom.plans.materialize import broadcast_if_small, materialize, ship_package

#: Seconds worked in a year of eight-hour days: income a year over this is what a second costs.
WORK_SECONDS = 365 * 8 * 3600


class PathTree:
    """The cheapest paths from one source, which follows as edges go out of use.

    ``out`` and ``into`` list (node, cost, edge) of a node's edges from and to it."""

    def __init__(self, out: dict, into: dict, source):
        self.out, self.into = out, into
        self.cost, self.way, self.kids = {}, {}, {}  # way: (predecessor, edge)
        self._grow([(0.0, source, None, None)], None)

    def _grow(self, heap: list, among: set | None, closed: Callable | None = None) -> None:
        heapify(heap)
        while heap:
            cost, node, prev, edge = heappop(heap)
            if node in self.cost:
                continue
            self.cost[node], self.way[node] = cost, (prev, edge)
            if prev is not None:
                self.kids.setdefault(prev, set()).add(node)
            for to, step, e in self.out.get(node, ()):
                if to not in self.cost and (among is None or to in among) and not (closed and closed(e)):
                    heappush(heap, (cost + step, to, node, e))

    def close(self, ends: list[tuple], closed: Callable) -> set:
        """Takes the edges of ``ends`` [(from, to, edge)] out of use; ``closed(edge)`` tells
        all that are by now. Only what hung below a broken edge of the tree is
        searched again, from the rest of the tree; those nodes come back."""
        below = [v for u, v, e in ends if self.way.get(v) == (u, e)]
        cut: set = set()
        while below:
            node = below.pop()
            if node not in cut:
                cut.add(node)
                below += self.kids.get(node, ())
        for node in cut:
            prev = self.way.pop(node)[0]
            if prev not in cut:
                self.kids[prev].discard(node)
            del self.cost[node]
            self.kids.pop(node, None)
        self._grow([(self.cost[x] + step, node, x, e) for node in cut for x, step, e in self.into.get(node, ()) if x in self.cost and not closed(e)], cut, closed)
        return cut


def draw_order(edges: DataFrame, draws: int, key: Callable[[Column, Column], Column]) -> DataFrame:
    """(edge_id, draw, rank): each draw's own order of the distinct edge ids, by
    ``key(edge_id, draw)``; a scenario closes the first ones, so a greater share
    closes what a smaller one does. Ranked in dealt ranges, not a draw a task."""
    each = edges.select("edge_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keyed = each.withColumn("_key", key(F.col("edge_id"), F.col("draw").cast("long")))
    return running(keyed, ["draw"], ["_key", "edge_id"]).select("edge_id", "draw", F.col("rank").cast("long").alias("rank"))


def scenario_costs(edges: DataFrame, origins: DataFrame, destinations: DataFrame, percents: Sequence[float], draws: int, key: Callable | None = None, seed: int = 1, heap_edges: int = 500_000, block: int = 20_000_000) -> tuple[DataFrame, DataFrame]:
    """(base, changed): base(o, d, base) of the pairs with a path, and changed(percent,
    draw, o, d, base, cost) of those whose cost differs (null: no path) in the
    scenario in which the draw's first ``percent`` of edge ids (rounded down) are
    out of use. ``edges(u, v, cost, edge_id)`` are directed; edges that share an
    id break together.

    Up to ``heap_edges`` edges are broadcast. Each task holds its origins' path
    trees and repairs them (:class:`PathTree`), scenario after scenario of a
    draw; the orders of a block of draws (``block`` numbers at most) are
    broadcast at a time. Larger networks are searched in DataFrame rounds."""
    spark = edges.sparkSession
    key = key or (lambda e, d: F.xxhash64(F.lit(seed), e, d))
    edges = materialize(edges.select("u", "v", F.col("cost").cast("double").alias("cost"), "edge_id"), "edges")
    order = materialize(draw_order(edges, draws, key), "order")
    ids = edges.select("edge_id").distinct().count()
    closes = {float(p): int(ids * p / 100) for p in sorted(percents)}
    starts, ends = origins.select("o").distinct(), destinations.select("d").distinct()
    if edges.limit(heap_edges + 1).count() > heap_edges:
        return _in_rounds(edges, order, starts, ends, closes)
    ship_package(spark)
    out: dict = {}
    into: dict = {}
    by_id: dict = {}
    number: dict = {}
    for r in edges.collect():  # at most heap_edges
        e = number.setdefault(r["edge_id"], len(number))
        out.setdefault(r["u"], []).append((r["v"], r["cost"], e))
        into.setdefault(r["v"], []).append((r["u"], r["cost"], e))
        by_id.setdefault(e, []).append((r["u"], r["v"], e))
    graph = spark.sparkContext.broadcast((out, into, by_id, closes))
    kind = dict(starts.dtypes)["o"]
    spread = materialize(starts.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "o"), "origins")
    wanted = broadcast_if_small(ends, 1_000_000)

    def base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for o in batch["o"].tolist():
                found = PathTree(*graph.value[:2], o).cost
                yield pd.DataFrame({"o": [o] * len(found), "d": list(found), "base": list(found.values())})

    paths = materialize(spread.mapInPandas(base, f"o {kind}, d {kind}, base double").filter("o <> d").join(wanted, "d", "left_semi"), "base")
    changed = None
    step = max(1, block // max(1, ids))
    for first in range(0, draws, step):
        own = order.filter((F.col("draw") >= first) & (F.col("draw") < first + step)).collect()  # at most ``block`` rows
        ranks = {d: np.full(len(number), ids) for d in range(first, min(draws, first + step))}
        for r in own:
            ranks[r["draw"]][number[r["edge_id"]]] = r["rank"]
        held = spark.sparkContext.broadcast({d: (x, np.argsort(x)) for d, x in ranks.items()})

        def scenarios(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            out, into, by_id, closes = graph.value
            for batch in batches:
                for o in batch["o"].tolist():
                    for draw, (rank, sequence) in held.value.items():
                        tree, done, touched, rows = PathTree(out, into, o), 0, set(), []
                        was = dict(tree.cost)
                        for percent, n in closes.items():
                            new = [end for e in sequence[done:n].tolist() for end in by_id[e]]
                            touched |= tree.close(new, lambda e, n=n, rank=rank: rank[e] < n)
                            done = n
                            rows += [(percent, draw, o, d, was[d], tree.cost.get(d)) for d in touched if d != o and tree.cost.get(d) != was[d]]
                        yield pd.DataFrame(rows, columns=["percent", "draw", "o", "d", "base", "cost"])

        part = spread.mapInPandas(scenarios, f"percent double, draw int, o {kind}, d {kind}, base double, cost double").join(wanted, "d", "left_semi")
        part = materialize(part.withColumn("cost", F.nanvl("cost", F.lit(None).cast("double"))), "changed")
        held.destroy()
        changed = part if changed is None else changed.unionByName(part)
    graph.destroy()
    names = ["percent", "draw", "o", "d", "base", "cost"]
    return paths.select("o", "d", "base"), changed.select(*names)


def _in_rounds(edges: DataFrame, order: DataFrame, starts: DataFrame, ends: DataFrame, closes: dict[float, int]) -> tuple[DataFrame, DataFrame]:
    scenarios = edges.sparkSession.createDataFrame([*closes.items()], "percent double, _n long")
    at = order.join(F.broadcast(scenarios)).filter("rank >= _n").select("percent", "draw", "edge_id")
    open_edges = at.join(edges, "edge_id").select("percent", "draw", "u", "v", "cost")
    named = order.select("draw").distinct().join(F.broadcast(scenarios.select("percent")))
    base = shortest_paths(edges, starts, heap_edges=0).filter("o <> node").select("o", F.col("node").alias("d"), F.col("cost").alias("base")).join(ends, "d", "left_semi")
    keys = ("percent", "draw")
    now = shortest_paths(open_edges, named.join(starts).select(*keys, "o"), keys=keys, heap_edges=0).select(*keys, "o", F.col("node").alias("d"), "cost")
    every = named.join(base.select("o", "d", "base"))
    changed = every.join(now, [*keys, "o", "d"], "left").filter("cost is null or cost <> base")
    return base.select("o", "d", "base"), changed.select(*keys, "o", "d", "base", "cost")


def monte_carlo(edges: DataFrame, demand: DataFrame, percents: Sequence[float], draws: int, income: float, slow: float = 0.3, elasticities: tuple[float, ...] = (-0.15, -0.36), **how) -> DataFrame:
    """(percent, draw, isolated, delay, slowed, loss_<100 e>, lost_share_<100 e>...): what
    becomes of the trips of demand(o, d, flow) when the edges of each scenario
    of :func:`scenario_costs` are out of use.

    Only trips count that have a path while all edges are open. ``isolated`` is
    their share without one now. Of the others, ``delay`` is the mean rise of
    cost a trip and ``slowed`` the share whose cost rises by over ``slow``. Costs
    in seconds become money by ``income`` a year; for an elasticity e (the fall
    of cost a trip gained) demand falls along a line, to nothing where the cost
    is e * flow higher: ``loss_<100 e>`` is the surplus lost, of isolated trips all,
    and ``lost_share_<100 e>`` its share of all the surplus. Null where no trip is left
    to compare; scenarios that change nothing have zeros."""
    flow = materialize(demand.filter("o <> d").groupBy("o", "d").agg(F.sum(F.col("flow").cast("double")).alias("flow")), "demand")
    base, changed = scenario_costs(edges, flow.select("o"), flow.select("d"), percents, draws, **how)
    money = income / WORK_SECONDS
    total = base.join(flow, ["o", "d"]).agg(F.sum("flow").alias("_trips"), *(F.sum(-e * F.col("flow") * F.col("flow") / 2).alias(f"_all_{round(100 * abs(e))}") for e in elasticities))
    cut = F.col("cost").isNull()
    sums = []
    for e in elasticities:
        most = -e * F.col("flow")  # the rise at which nobody goes any more
        rise = F.when(cut, most).otherwise(F.least(money * (F.col("cost") - F.col("base")), most))
        left = F.col("flow") + rise / e
        sums.append(F.sum(rise * left - rise * (rise / e) / 2).alias(f"_loss_{round(100 * abs(e))}"))
    by = changed.join(flow, ["o", "d"]).groupBy("percent", "draw").agg(
        F.sum(F.when(cut, F.col("flow")).otherwise(0.0)).alias("_cut"),
        F.sum(F.when(~cut, F.col("flow") * (F.col("cost") - F.col("base"))).otherwise(0.0)).alias("_late"),
        F.sum(F.when(~cut & (F.col("cost") > (1 + slow) * F.col("base")), F.col("flow")).otherwise(0.0)).alias("_slow"),
        *sums,
    )
    spark = edges.sparkSession
    scenarios = spark.createDataFrame([(float(p), d) for p in percents for d in range(draws)], "percent double, draw int")
    out = scenarios.join(by, ["percent", "draw"], "left").join(F.broadcast(total)).fillna(0.0)
    open_trips = F.nullif(F.col("_trips") - F.col("_cut"), F.lit(0.0))
    money_columns = [c for e in elasticities for k in (f"{round(100 * abs(e))}",) for c in (F.col(f"_loss_{k}").alias(f"loss_{k}"), (F.col(f"_loss_{k}") / F.nullif(F.col(f"_all_{k}"), F.lit(0.0))).alias(f"lost_share_{k}"))]
    return out.select("percent", "draw", (F.col("_cut") / F.nullif(F.col("_trips"), F.lit(0.0))).alias("isolated"), (F.col("_late") / open_trips).alias("delay"), (F.col("_slow") / open_trips).alias("slowed"), *money_columns)
