"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.materialize import materialize, ship_package


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(low, "u")
        .filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``, where the component
    is named by its smallest node.

    Alternating large-star and small-star rounds: each is one aggregate (with
    map-side combine) and one equi-join, so a hub with very many neighbours is
    a skewed join that adaptive execution can split, never one task's list.
    Loops (u = v) and null ends are ignored. Each round is written to the
    shared folder, so lineage stays one round deep.
    """
    now = materialize(
        edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = materialize(_small_star(materialize(_large_star(now), "edges")), "edges")
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )


def _folded(batches: Iterator[pd.DataFrame], few: int) -> Iterator[pd.DataFrame]:
    """(node, root) of edges(u, v), chunk by chunk: each node with the smallest that it reaches within the chunk."""

    def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
        both = pd.concat(parts, ignore_index=True)
        names, codes = np.unique(np.concatenate((both["u"].to_numpy(), both["v"].to_numpy())), return_inverse=True)
        u, v, label = codes[: len(both)], codes[len(both) :], np.arange(len(names))
        while True:
            low, new = np.minimum(label[u], label[v]), label.copy()
            for ends in (label[u], label[v]):
                np.minimum.at(new, ends, low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                return pd.DataFrame({"node": names, "root": names[label]})
            label = new

    parts, n = [], 0
    for batch in batches:
        if len(batch):
            parts.append(batch)
            n += len(batch)
        if n >= few:
            yield fold(parts)
            parts, n = [], 0
    if parts:
        yield fold(parts)


def near_components(edges: DataFrame, few: int = 500_000) -> DataFrame:
    """:func:`connected_components` of edges(u, v) between numbers, most of which are near
    those that they link: rows dealt by range are first joined within chunks of
    ``few``, and only what lies in several chunks is joined in rounds."""
    ship_package(edges.sparkSession)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("u", "v").filter("u <> v").repartitionByRange(tasks, "u").sortWithinPartitions("u")
    found = materialize(dealt.mapInPandas(lambda batches: _folded(batches, few), "node long, root long"), "folded")
    own = materialize(found.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")), "roots")
    top = connected_components(own.filter(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("low").alias("v")))
    return own.join(top.withColumnRenamed("node", "low"), "low", "left").select("node", F.coalesce("component", "low").alias("component"))


def _whole(arcs: DataFrame) -> DataFrame:
    """(node, component) of the ends of a bounded arc table(u, v), in one task: depth
    first, with the stack of open nodes."""
    kind = dict(arcs.dtypes)["u"]
    ship_package(arcs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        both = pd.concat(parts, ignore_index=True)
        codes, names = pd.factorize(pd.concat([both["u"], both["v"]], ignore_index=True))
        ahead: list[list[int]] = [[] for _ in names]
        for u, v in zip(codes[: len(both)].tolist(), codes[len(both) :].tolist(), strict=True):
            ahead[u].append(v)
        label = strong_labels(ahead)
        yield pd.DataFrame({"node": names, "component": [names[k] for k in label]})

    return arcs.select("u", "v").coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def strong_labels(ahead: list[list[int]]) -> list[int]:
    """For each node, one node of its strong component, the same for all of them."""
    n = len(ahead)
    seen, low, label, count = [-1] * n, [0] * n, [-1] * n, 0
    held: list[int] = []
    for root in range(n):
        if seen[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            node, k = todo.pop()
            if k == 0:
                seen[node] = low[node] = count
                count += 1
                held.append(node)
            elif label[ahead[node][k - 1]] < 0:
                low[node] = min(low[node], low[ahead[node][k - 1]])
            while k < len(ahead[node]) and seen[ahead[node][k]] >= 0:
                if label[ahead[node][k]] < 0:
                    low[node] = min(low[node], seen[ahead[node][k]])
                k += 1
            if k < len(ahead[node]):
                todo.append((node, k + 1))
                todo.append((ahead[node][k], 0))
            elif low[node] == seen[node]:
                while True:
                    at = held.pop()
                    label[at] = node
                    if at == node:
                        break
    return label


def _trim(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs left, nodes(node) that go): nodes that no arc enters or none leaves are components of their own."""
    flags = arcs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(arcs.select("v", F.lit(0), F.lit(1)))
    gone = materialize(flags.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in")).filter("out = 0 or in = 0").select("node"), "gone")
    off = lambda end: gone.select(F.col("node").alias(end))
    return arcs.join(off("u"), "u", "left_anti").join(off("v"), "v", "left_anti"), gone


def _follow(step: DataFrame, n: int) -> DataFrame:
    """(node, low, end) of step(node, to): the first node after ``node`` that has no
    step of its own (null for nodes that run in a ring) and the smallest node met
    on the way, by pointer doubling: about log2(n) rounds for ``n`` steps."""
    now = materialize(step.select("node", F.col("to"), F.least("node", "to").alias("low"), F.lit(False).alias("at_end")), "follow")
    for _ in range(max(1, n).bit_length() + 1):
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("at_end").alias("_end"))
        met = now.join(ahead, "to", "left")
        stop = F.col("at_end") | F.col("_to").isNull()
        now = materialize(met.select("node", F.when(stop, F.col("to")).otherwise(F.col("_to")).alias("to"), F.when(stop, F.col("low")).otherwise(F.least("low", "_low")).alias("low"), (stop | F.col("_end")).alias("at_end")), "follow")
        if now.filter("not at_end").isEmpty():
            break
    return now.select("node", "low", F.when(F.col("at_end"), F.col("to")).alias("end"))


def _compress(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(arcs left, chains(node, a, b), rings(node, component)): nodes with one arc in
    and one out are drawn into an arc from the node a before their chain to the
    node b after it; chains that close are components. None if there is no such node."""
    ins = arcs.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("u").alias("back"))
    outs = arcs.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("v").alias("to"))
    links = materialize(ins.join(outs, "node").filter("i = 1 and o = 1").select("node", "back", "to"), "links")
    n = links.count()
    if not n:
        return None
    after, before = _follow(links.select("node", "to"), n), _follow(links.select("node", F.col("back").alias("to")), n)
    both = materialize(after.select("node", "low", F.col("end").alias("b")).join(before.select("node", F.col("end").alias("a")), "node"), "chains")
    chains, rings = both.filter("a is not null").select("node", "a", "b"), both.filter("a is null").select("node", F.col("low").alias("component"))
    off = lambda end: links.select(F.col("node").alias(end))
    left = arcs.join(off("u"), "u", "left_anti").join(off("v"), "v", "left_anti")
    return left.union(chains.select(F.col("a").alias("u"), F.col("b").alias("v"))).filter("u <> v").distinct(), chains, rings


def _coloured(arcs: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(arcs left, found(node, component)): the smallest hashed name spreads forward
    over the arcs; each name's own node then collects, backward among its name,
    those that also reach it. All names work at once."""
    nodes = arcs.select(F.col("u").alias("node")).union(arcs.select("v")).distinct()
    name = materialize(nodes.withColumn("name", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))), "names")
    for _ in range(max_rounds):
        told = arcs.join(name, arcs["u"] == name["node"]).groupBy(F.col("v").alias("node")).agg(F.min("name").alias("heard"))
        new = materialize(name.join(told, "node", "left").select("node", F.least("name", F.coalesce("heard", "name")).alias("name"), (F.col("heard") < F.col("name")).alias("fell")), "names")
        name = new.select("node", "name")
        if new.filter("fell").isEmpty():
            break
    else:
        raise RuntimeError(f"names did not settle within {max_rounds} rounds")
    at = lambda end: name.select(F.col("node").alias(end), F.col("name").alias(f"name_{end}"))
    same = materialize(arcs.join(at("u"), "u").join(at("v"), "v").filter("name_u = name_v").select("u", "v"), "same")
    front = materialize(name.filter("node = name.n").select("node", F.col("node").alias("component")), "front")
    found = front
    for _ in range(max_rounds):
        front = same.join(front, same["v"] == front["node"]).select(F.col("u").alias("node"), "component").distinct().join(found.select("node"), "node", "left_anti")
        front = materialize(front, "front")
        if front.isEmpty():
            break
        found = materialize(found.unionByName(front), "found")
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    off = lambda end: found.select(F.col("node").alias(end))
    return arcs.join(off("u"), "u", "left_anti").join(off("v"), "v", "left_anti"), found


def strong_components(edges: DataFrame, max_rounds: int = 1_000, few: int = 500_000) -> DataFrame:
    """(node, component) of the directed edges(u, v): nodes that reach each other
    share a component, named by its smallest node. Loops and null ends are ignored.

    A network of at most ``few`` arcs is settled in one task. A larger one is
    first made smaller: nodes without an arc in or out go, and chains of nodes
    with one arc in and one out become one arc by pointer doubling, so one-way
    roads and trees of any length take about as many rounds as their length has
    binary digits. What is left over ``few`` arcs is coloured in rounds, in which
    a node's name travels one arc a round."""
    arcs = materialize(edges.select("u", "v").filter("u <> v").distinct(), "arcs")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).filter("node is not null").distinct()
    found, chains = [], []
    for _ in range(max_rounds):
        n = arcs.count()
        if n <= few:
            if n:
                found.append(materialize(_whole(arcs), "core"))
            break
        left, gone = _trim(arcs)
        found.append(gone.withColumn("component", F.col("node")))
        pressed = _compress(materialize(left, "arcs"))
        if pressed:
            left, chain, rings = pressed
            chains.append(chain)
            found.append(rings)
        left = materialize(left, "arcs")
        if left.count() > 0.9 * n:  # neither helps much any more
            left, core = _coloured(left, max_rounds)
            found.append(core)
            left = materialize(left, "arcs")
        arcs = left
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    known = None
    for part in found:
        known = part if known is None else known.unionByName(part)
    for chain in reversed(chains):  # a chain belongs to its ends if they are one component
        known = materialize(known, "known")
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))  # noqa: B023, E731
        own = chain.join(of("a"), "a", "left").join(of("b"), "b", "left")
        one = F.coalesce(F.col("_a"), F.col("a")) == F.coalesce(F.col("_b"), F.col("b"))
        known = known.unionByName(own.select("node", F.when(one, F.coalesce(F.col("_a"), F.col("a"))).otherwise(F.col("node")).alias("component")))
    if known is None:
        return nodes.withColumn("component", F.col("node"))
    every = materialize(nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    least = every.groupBy("component").agg(F.min("node").alias("_least"))
    return every.join(least, "component").select("node", F.col("_least").alias("component"))


def largest_component(edges: DataFrame, strong: bool = False) -> DataFrame:
    """The edges inside the component with the most nodes (ties: the smallest name), weak or strong."""
    parts = materialize((strong_components if strong else connected_components)(edges), "parts")
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = parts.join(F.broadcast(best), "component", "left_semi").select("node")
    return edges.join(keep.withColumnRenamed("node", "u"), "u", "left_semi").join(keep.withColumnRenamed("node", "v"), "v", "left_semi").select(*edges.columns)
