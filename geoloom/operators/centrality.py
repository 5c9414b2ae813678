"""Figures of whole networks: betweenness over all equal shortest paths, closeness, diameter, cycles, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components
from geoloom.operators.routing import shortest_paths
from geoloom.plans.materialize import materialize


def path_graph(edges: DataFrame, paths: DataFrame, near: float = 1e-9) -> DataFrame:
    """(o, u, v): the edges that lie on a shortest path from o, equal ones included, by
    paths(o, node, cost); costs must be above zero and are equal within ``near`` of their size."""
    steps = edges.filter("u <> v").groupBy("u", "v").agg(F.min("cost").alias("step"))
    at = lambda end: paths.select("o", F.col("node").alias(end), F.col("cost").alias(f"_{end}"))
    met = at("u").join(steps, "u").join(at("v"), ["o", "v"])
    return met.filter(F.abs(F.col("_u") + F.col("step") - F.col("_v")) <= near * (1 + F.col("_v"))).select("o", "u", "v")


def path_counts(graph: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(o, node, paths): how many shortest paths lead from o to each node of
    graph(o, u, v). Round k adds those of k edges, of all origins at once."""
    front = materialize(graph.select("o", F.col("o").alias("node")).distinct().withColumn("n", F.lit(1.0)), "front")
    total = front
    for _ in range(max_rounds):
        front = front.join(graph.withColumnRenamed("u", "node"), ["o", "node"]).groupBy("o", F.col("v").alias("node")).agg(F.sum("n").alias("n"))
        front = materialize(front, "front")
        if front.isEmpty():
            return total.groupBy("o", "node").agg(F.sum("n").alias("paths"))
        total = materialize(total.unionByName(front).groupBy("o", "node").agg(F.sum("n").alias("n")), "counts")
    raise RuntimeError(f"paths are longer than {max_rounds} edges")


def dependencies(graph: DataFrame, counts: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(o, u, v, share): for each edge of graph(o, u, v) the number of destinations whose
    shortest paths from o run over it, each path counting its part of the pair's.

    The dependency of a node is one (itself) and that of the nodes behind it,
    shared out by counts of paths; it is gathered from the far ends inwards,
    a round for each edge on the longest path, of all origins at once."""
    of = lambda end: counts.select("o", F.col("node").alias(end), F.col("paths").alias(f"_{end}"))
    parts = materialize(graph.join(of("u"), ["o", "u"]).join(of("v"), ["o", "v"]).select("o", "u", "v", (F.col("_u") / F.col("_v")).alias("part")), "parts")
    front = materialize(counts.select("o", "node", F.lit(1.0).alias("x")), "front")
    total = front
    for _ in range(max_rounds):
        front = parts.join(front.withColumnRenamed("node", "v"), ["o", "v"]).groupBy("o", F.col("u").alias("node")).agg(F.sum(F.col("part") * F.col("x")).alias("x"))
        front = materialize(front, "front")
        if front.isEmpty():
            return parts.join(total.withColumnRenamed("node", "v"), ["o", "v"]).select("o", "u", "v", (F.col("part") * F.col("x")).alias("share"))
        total = materialize(total.unionByName(front).groupBy("o", "node").agg(F.sum("x").alias("x")), "total")
    raise RuntimeError(f"paths are longer than {max_rounds} edges")


def betweenness(edges: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes(node, betweenness) and edges(u, v, betweenness) of directed
    edges(u, v, cost) with costs above zero: over all ordered pairs of other
    nodes, the share of the pair's shortest paths that run through, equal paths
    counted alike. Nodes and edges that no such path uses are left out."""
    if paths is None:
        paths = shortest_paths(edges, edges.select(F.col("u").alias("o")))
    graph = materialize(path_graph(edges, paths), "graph")
    shares = materialize(dependencies(graph, materialize(path_counts(graph), "counts")), "shares")
    by_edge = shares.groupBy("u", "v").agg(F.sum("share").alias("betweenness"))
    # What runs over the edges out of a node other than the origin has passed the node.
    by_node = shares.filter("u <> o").groupBy(F.col("u").alias("node")).agg(F.sum("share").alias("betweenness"))
    return by_node, by_edge


def closeness(paths: DataFrame) -> DataFrame:
    """(node, reached, mean_cost, farthest, closeness) of paths(o, node, cost), by origin:
    the others it reaches, their mean and greatest cost, and reached divided by
    the sum of costs, scaled by the share of all nodes reached."""
    n = paths.select("node").distinct().agg(F.count(F.lit(1)).alias("_n"))
    by = paths.filter("o <> node").groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("reached"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("farthest"), F.sum("cost").alias("_s"))
    return by.join(F.broadcast(n)).select("node", "reached", "mean_cost", "farthest", (F.col("reached") / F.nullif(F.col("_s"), F.lit(0.0)) * F.col("reached") / F.nullif(F.col("_n") - 1, F.lit(0))).alias("closeness"))


def network_figures(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One row (nodes, edges, parts, cycles, reached_pairs, mean_cost, diameter,
    assortativity) of directed edges(u, v, cost). Parts, cycles (independent ones:
    edges less nodes plus parts) and assortativity (the correlation of the
    degrees at the ends of an edge) are those of the undirected graph; the
    diameter is the greatest cost between nodes that reach each other in a direction."""
    if paths is None:
        paths = shortest_paths(edges, edges.select(F.col("u").alias("o")).union(edges.select("v")))
    flat = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "flat")
    both = flat.union(flat.select("v", "u"))
    degree = materialize(both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("k")), "degree")
    at = lambda end: degree.select(F.col("node").alias(end), F.col("k").alias(f"k_{end}"))
    mixing = both.join(at("u"), "u").join(at("v"), "v").agg(F.corr("k_u", "k_v").alias("assortativity"))
    parts = connected_components(flat).agg(F.countDistinct("component").alias("parts"))
    sizes = degree.agg(F.count(F.lit(1)).alias("nodes")).join(flat.agg(F.count(F.lit(1)).alias("edges"))).join(parts)
    costs = paths.filter("o <> node").agg(F.count(F.lit(1)).alias("reached_pairs"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("diameter"))
    return sizes.join(costs).join(mixing).select("nodes", "edges", "parts", (F.col("edges") - F.col("nodes") + F.col("parts")).alias("cycles"), "reached_pairs", "mean_cost", "diameter", "assortativity")
