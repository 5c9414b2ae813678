"""Shortest paths, origin-destination matrices and what is computed on them."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import cell
from geoloom.plans.materialize import broadcast_if_small, materialize, ship_package

Graph = dict[tuple, dict[object, list[tuple[object, float]]]]


def _search(moves: dict, source, cutoff: float | None, closed: tuple | None = None) -> list[tuple]:
    """(node, cost, prev, hops) reached from a source, by a heap, without the
    ``closed`` edge; of equal costs the fewer hops win, then the smaller predecessor."""
    out, done, heap = [], set(), [(0.0, 0, source, None)]
    while heap:
        cost, hops, node, prev = heappop(heap)
        if node in done:
            continue
        done.add(node)
        out.append((node, cost, prev, hops))
        for to, step in moves.get(node, ()):
            if to not in done and (cutoff is None or cost + step <= cutoff) and (node, to) != closed:
                heappush(heap, (cost + step, hops + 1, to, node))
    return out


def _by_heap(moves: DataFrame, start: DataFrame, own: list[str], keys: tuple[str, ...], cutoff: float | None, closed: tuple[str, str] | None) -> DataFrame:
    """The search where the edges fit into every task: they are broadcast, the sources are dealt out."""
    spark = moves.sparkSession
    ship_package(spark)
    graph: Graph = {}
    for r in moves.collect():
        graph.setdefault(tuple(r[k] for k in own), {}).setdefault(r["node"], []).append((r["to"], r["step"]))
    held = spark.sparkContext.broadcast(graph)
    kinds = dict(start.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"o {kinds['o']}", f"node {kinds['o']}", "cost double", f"prev {kinds['o']}", "hops int"])
    names = [*keys, "o", "node", "cost", "prev", "hops"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                lead = [row[k] for k in keys]
                found = _search(held.value.get(tuple(row[k] for k in own), {}), row["o"], cutoff, tuple(row[k] for k in closed) if closed else None)
                yield pd.DataFrame([(*lead, row["o"], *x) for x in found], columns=names).astype({"prev": object})

    spread = start.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "o")
    return materialize(spread.mapInPandas(run, schema), "dist")


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, keys: tuple[str, ...] = (), max_rounds: int = 10_000, heap_edges: int = 500_000, closed: tuple[str, str] | None = None) -> DataFrame:
    """(*keys, o, node, cost, prev, hops) of the cheapest path from each source.

    ``edges(u, v, cost)`` are directed, with costs of zero or more; ``sources``
    has ``o`` and the ``keys`` (a scenario, say). Where edges carry the keys
    too, each scenario sees its own edges; ``closed`` names two of the keys that
    hold the ends of an edge which is out of use for that source. Nodes out of
    reach, or beyond ``cutoff``, have no row. Of equal costs the path with fewer
    hops is told, then that by the smaller predecessor.

    Up to ``heap_edges`` edges are broadcast and each task searches from its own
    sources. A larger network is relaxed in rounds: only nodes whose cost has
    just fallen are expanded, all sources at once, by one equi-join on the node
    and one keyed minimum, written to the shared folder.
    """
    own = [k for k in keys if k in edges.columns]
    moves = edges.select(*own, F.col("u").alias("node"), F.col("v").alias("to"), F.col("cost").alias("step")).filter("node <> to")
    moves = materialize(moves.groupBy(*own, "node", "to").agg(F.min("step").alias("step")), "moves")
    start = sources.select(*keys, "o").distinct()
    if moves.limit(heap_edges + 1).count() <= heap_edges:
        return _by_heap(moves, start, own, keys, cutoff, closed)
    best = materialize(start.select("*", F.col("o").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(dict(start.dtypes)["o"]).alias("prev"), F.lit(0).alias("hops")), "dist")
    front = best
    for _ in range(max_rounds):
        met = front.join(moves, [*own, "node"])
        if closed:
            met = met.filter((F.col("node") != F.col(closed[0])) | (F.col("to") != F.col(closed[1])))
        tried = met.select(
            *keys, "o", F.col("to").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.col("node").alias("prev"), (F.col("hops") + 1).alias("hops")
        )
        if cutoff is not None:
            tried = tried.filter(F.col("cost") <= cutoff)
        tried = tried.groupBy(*keys, "o", "node").agg(F.min(F.struct("cost", "hops", "prev")).alias("new"))
        old = best.select(*keys, "o", "node", F.struct("cost", "hops", F.coalesce("prev", "o").alias("prev")).alias("_old"))
        better = tried.join(old, [*keys, "o", "node"], "left").filter("node <> o and (_old is null or new < _old)").select(*keys, "o", "node", "new.cost", "new.prev", "new.hops")
        front = materialize(better, "front")
        if front.isEmpty():
            return best
        gone = front.select(*keys, "o", "node")
        best = materialize(best.join(gone, [*keys, "o", "node"], "left_anti").unionByName(front), "dist")
    raise RuntimeError(f"paths did not settle within {max_rounds} rounds")


def od_matrix(edges: DataFrame, origins: DataFrame, destinations: DataFrame, fail_value: float | None = None, cutoff: float | None = None) -> DataFrame:
    """(o, d, cost) of the pairs of origins(o) and destinations(d) with a path; with
    a ``fail_value`` of all pairs, those without a path at that cost."""
    found = shortest_paths(edges, origins, cutoff).select("o", F.col("node").alias("d"), "cost")
    ends = broadcast_if_small(destinations.select("d").distinct(), 100_000)
    if fail_value is None:
        return found.join(ends, "d", "left_semi").select("o", "d", "cost")
    pairs = origins.select("o").distinct().crossJoin(ends)
    return pairs.join(found, ["o", "d"], "left").withColumn("cost", F.coalesce("cost", F.lit(float(fail_value))))


def _jumps(steps: DataFrame) -> Iterator[DataFrame]:
    """Tables (o, node, up) of each node's ancestor 1, 2, 4, ... steps up the path
    trees of steps(o, node, prev): each the one before joined with itself, so a
    path of n hops takes about log2(n) of them."""
    now = steps.select("o", "node", F.col("prev").alias("up"))
    for _ in range(64):
        now = materialize(now, "jumps")
        if now.isEmpty():
            return
        yield now
        now = now.join(now.select("o", F.col("node").alias("up"), F.col("up").alias("_up")), ["o", "up"]).select("o", "node", F.col("_up").alias("up"))
    raise ValueError("the predecessors of the paths run in a circle")


def assign_flows(paths: DataFrame, demand: DataFrame) -> DataFrame:
    """(u, v, flow): all-or-nothing assignment of demand(o, d, flow) to the paths.

    The flow into a node is the demand of all that lies behind it in its
    origin's tree: sums over descendants less than 1, 2, 4, ... steps away, each
    from the one before, whatever the length of the paths."""
    steps = materialize(paths.filter("prev is not null").select("o", "node", "prev"), "steps")
    own = demand.filter("o <> d").groupBy("o", F.col("d").alias("node")).agg(F.sum(F.col("flow").cast("double")).alias("flow"))
    below = materialize(own, "below")
    for jump in _jumps(steps):
        carried = below.join(jump, ["o", "node"]).select("o", F.col("up").alias("node"), "flow")
        below = materialize(below.unionByName(carried).groupBy("o", "node").agg(F.sum("flow").alias("flow")), "below")
    return below.join(steps, ["o", "node"]).groupBy(F.col("prev").alias("u"), F.col("node").alias("v")).agg(F.sum("flow").alias("flow"))


def path_edges(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(o, d, seq, u, v): the edges of the path of each pair(o, d), seq counted back from the destination."""
    steps = materialize(paths.filter("prev is not null").select("o", "node", "prev"), "steps")
    met = pairs.select("o", "d").distinct().select("o", "d", F.col("d").alias("node"), F.lit(0).alias("seq"))
    met = materialize(met.join(steps.select("o", "node"), ["o", "node"], "left_semi"), "route")
    for k, jump in enumerate(_jumps(steps)):
        further = met.join(jump, ["o", "node"]).select("o", "d", F.col("up").alias("node"), (F.col("seq") + (1 << k)).alias("seq"))
        met = materialize(met.unionByName(further), "route")
    return met.join(steps, ["o", "node"]).select("o", "d", "seq", F.col("prev").alias("u"), F.col("node").alias("v"))


def break_edges(edges: DataFrame, tested: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """(edge_u, edge_v, o, d, base, cost): the OD costs with each tested edge(u, v) out of use.

    All scenarios are one search over one set of edges, in which each source
    carries the edge it may not use; only pairs whose base path uses the edge can
    change, so only their origins are searched again."""
    base = shortest_paths(edges, origins)
    ends = destinations.select("d").distinct()
    pairs = base.filter("o <> node").join(ends, base["node"] == ends["d"], "left_semi").select("o", F.col("node").alias("d"))
    used = path_edges(base, pairs).join(tested.select("u", "v").distinct(), ["u", "v"], "left_semi")
    used = materialize(used.select(F.col("u").alias("edge_u"), F.col("v").alias("edge_v"), "o", "d").distinct(), "used")
    keys = ("edge_u", "edge_v")
    again = shortest_paths(edges, used.select(*keys, "o"), keys=keys, closed=keys).select(*keys, "o", F.col("node").alias("d"), "cost")
    old = base.select("o", F.col("node").alias("d"), F.col("cost").alias("base"))
    return used.join(old, ["o", "d"]).join(again, [*keys, "o", "d"], "left").select(*keys, "o", "d", "base", "cost")


def k_shortest(edges: DataFrame, pairs: DataFrame, k: int, max_hops: int) -> DataFrame:
    """(o, d, rank, cost, path): up to k cheapest loopless paths of each pair(o, d)
    with at most ``max_hops`` edges, ties by fewer, then smaller nodes.

    Paths grow by one edge a round, all pairs at once. A prefix is dropped only
    where it can't be among the k: its cost plus the shortest way on exceeds the
    cost of k complete paths already known for the pair."""
    moves = edges.filter("u <> v").groupBy("u", "v").agg(F.min("cost").alias("step"))
    moves = materialize(moves, "moves")
    back = shortest_paths(moves.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("step").alias("cost")), pairs.select(F.col("d").alias("o")))
    left = materialize(back.select(F.col("o").alias("d"), F.col("node"), F.col("cost").alias("left")), "left")
    now = pairs.select("o", "d").distinct().filter("o <> d").select("o", "d", F.col("o").alias("node"), F.lit(0.0).alias("cost"), F.array("o").alias("path"))
    best = Window.partitionBy("o", "d").orderBy("cost", F.size("path"), "path")
    done = None
    for _ in range(max_hops):
        grown = now.join(moves, now["node"] == moves["u"]).filter(~F.array_contains("path", F.col("v")))
        grown = grown.select("o", "d", F.col("v").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.array_append("path", F.col("v")).alias("path")).join(left, ["d", "node"])
        if done is not None:
            worst = done.groupBy("o", "d").agg(F.max(F.when(F.col("rank") == k, F.col("cost"))).alias("worst"))
            grown = grown.join(worst, ["o", "d"], "left").filter("worst is null or cost + left <= worst").drop("worst")
        grown = materialize(grown, "prefixes")
        ended = grown.filter("node = d").select("o", "d", "cost", "path")
        known = ended if done is None else done.drop("rank").unionByName(ended)
        done = materialize(known.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "known")
        now = grown.filter("node <> d").drop("left")
        if now.isEmpty():
            break
    return done.select("o", "d", "rank", "cost", "path")


def _deviations(moves: dict, back: dict, source, target, k: int) -> list[tuple[float, list]]:
    """The k cheapest loopless paths (cost, nodes) from source to target, ties by fewer,
    then smaller nodes: each next one leaves a known path at one of its nodes.

    ``back`` holds the cheapest cost from every node to the target; it guides the
    search for the way on, and shuts nodes out from which there is none."""

    def way_on(root: list, cost: float, barred: set):
        seen, start = set(root[:-1]), root[-1]
        heap = [(cost + back[start], len(root), root, cost)]
        best: dict = {}
        while heap:
            _, hops, path, now = heappop(heap)
            at = path[-1]
            if at == target:
                return now, path
            if best.get(at, (now, hops, path)) < (now, hops, path):
                continue
            for to, step in moves.get(at, ()):
                if to in back and to not in seen and to not in path and not (at == start and len(path) == len(root) and to in barred):
                    new = (now + step, hops + 1, [*path, to])
                    if to not in best or new < best[to]:
                        best[to] = new
                        heappush(heap, (new[0] + back[to], hops + 1, new[2], new[0]))
        return None

    first = way_on([source], 0.0, set()) if source in back and source != target else None
    known, open_paths, tried = [], [], set()
    while first is not None:
        cost, path = first
        known.append((cost, path))
        if len(known) == k:
            break
        steps = {(u, to): step for u in path for to, step in moves.get(u, ())}
        run = 0.0
        for i in range(len(path) - 1):
            root = path[: i + 1]
            barred = {p[i + 1] for _, p in known if p[: i + 1] == root}
            found = way_on(root, run, barred)
            if found is not None and tuple(found[1]) not in tried:
                tried.add(tuple(found[1]))
                heappush(open_paths, (found[0], len(found[1]), found[1]))
            run += steps[path[i], path[i + 1]]
        first = None
        if open_paths:
            cost, _, path = heappop(open_paths)
            first = (cost, path)
    return known


def k_paths(edges: DataFrame, pairs: DataFrame, k: int, heap_edges: int = 500_000) -> DataFrame:
    """(o, d, rank, cost, path): the k cheapest loopless paths (fewer, if there are no
    more) of each pair(o, d), of any number of edges.

    Up to ``heap_edges`` edges are broadcast; pairs are dealt out by destination,
    so that one search backward serves all origins of a destination in a task,
    and paths are found as deviations from those known. A larger network grows
    prefixes in rounds (:func:`k_shortest`, without a bound on their edges)."""
    moves = materialize(edges.filter("u <> v").groupBy("u", "v").agg(F.min("cost").cast("double").alias("step")), "moves")
    wanted = pairs.select("o", "d").distinct().filter("o <> d")
    if moves.limit(heap_edges + 1).count() > heap_edges:
        return k_shortest(edges, wanted, k, 1 << 30)
    spark = edges.sparkSession
    ship_package(spark)
    out: dict = {}
    into: dict = {}
    for r in moves.collect():
        out.setdefault(r["u"], []).append((r["v"], r["step"]))
        into.setdefault(r["v"], []).append((r["u"], r["step"]))
    held = spark.sparkContext.broadcast((out, into))
    kind = dict(wanted.dtypes)["o"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, into = held.value
        back, of = {}, object()
        for batch in batches:
            rows = []
            for o, d in zip(batch["o"].tolist(), batch["d"].tolist(), strict=True):
                if d != of:
                    back, of = {node: cost for node, cost, _, _ in _search(into, d, None)}, d
                rows += [(o, d, i, cost, path) for i, (cost, path) in enumerate(_deviations(out, back, o, d, k), 1)]
            yield pd.DataFrame(rows, columns=["o", "d", "rank", "cost", "path"])

    spread = wanted.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "d", "o").sortWithinPartitions("d", "o")
    return materialize(spread.mapInPandas(run, f"o {kind}, d {kind}, rank int, cost double, path array<{kind}>"), "paths")


def logit_split(paths: DataFrame, spread: float = 0.05) -> DataFrame:
    """``paths`` of :func:`k_shortest` with share: exp(-spread * cost) over the pair's
    paths; of paths of one pair with equal costs the first alone counts."""
    first = paths.withColumn("_n", F.row_number().over(Window.partitionBy("o", "d", F.round("cost", 9)).orderBy("rank"))).filter("_n = 1").drop("_n")
    pair = Window.partitionBy("o", "d")
    weight = F.exp(-spread * (F.col("cost") - F.min("cost").over(pair)))
    return first.withColumn("_w", weight).withColumn("share", F.col("_w") / F.sum("_w").over(pair)).drop("_w")


def isochrone(paths: DataFrame, thresholds: list[float]) -> DataFrame:
    """(o, threshold, nodes, farthest): how many nodes lie within each threshold."""
    spark = paths.sparkSession
    cuts = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return (
        paths.crossJoin(F.broadcast(cuts))
        .filter("cost <= threshold")
        .groupBy("o", "threshold")
        .agg(F.count(F.lit(1)).alias("nodes"), F.max("cost").alias("farthest"))
    )


def isochrone_cells(paths: DataFrame, nodes: DataFrame, thresholds: list[float], size: float, around: int = 0) -> DataFrame:
    """(o, threshold, cx, cy): the area within each threshold of an origin as cells,
    ``size`` wide: those of the nodes(node, x, y) reached, and ``around`` more on every side."""
    cuts = paths.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    at = nodes.select("node", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    met = paths.join(at, "node").crossJoin(F.broadcast(cuts)).filter("cost <= threshold").select("o", "threshold", "cx", "cy").distinct()
    span = F.sequence(F.lit(-around), F.lit(around))
    wide = met.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    return wide.select("o", "threshold", (F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy")).distinct()


def route_improvement(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(o, d, edges, cost, saved, mean_speed) of the routes in steps(o, d, u, v) over
    edges(u, v, cost, seconds, km, rural, seen, class_speed, speed): ``saved`` are the
    seconds that rural edges with an observed speed would save at the speed of
    their class; the mean speed, observed where known, is weighted by length."""
    known = steps.join(edges, ["u", "v"])
    observed = F.col("seen") > 0
    saved = F.when(observed & F.col("rural"), F.col("seconds") - F.col("km") / F.col("class_speed") * 3600).otherwise(0.0)
    speed = F.when(observed, F.col("seen")).otherwise(F.col("speed"))
    return known.groupBy("o", "d").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("cost").alias("cost"), F.sum(saved).alias("saved"), (F.sum(speed * F.col("km")) / F.sum("km")).alias("mean_speed")
    )
