"""Graph construction and cleaning over edge tables (u, v, cost, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import clip_ring, clip_segment, ring_area
from geoloom.operators.components import connected_components
from geoloom.operators.polygons import dissolved_cells, distinct_shapes, touching_pairs
from geoloom.operators.spatial import close_groups, nearest_join
from geoloom.plans.materialize import materialize


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct end points."""
    return edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()


def reflect_all(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse."""
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(back)


def reflect_missing(edges: DataFrame) -> DataFrame:
    """Adds (v, u) with the attributes of (u, v) where no edge (v, u) exists."""
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(back.join(edges.select("u", "v").distinct(), ["u", "v"], "left_anti"))


def simple_graph(edges: DataFrame, keep: str = "longest", by: str = "length", order: Sequence[str] = ()) -> DataFrame:
    """One edge of each ordered pair: the longest or the shortest, ties by ``order``."""
    key = F.col(by).desc() if keep == "longest" else F.col(by).asc()
    w = Window.partitionBy("u", "v").orderBy(key, *order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drop_clones(edges: DataFrame, max_ratio: float = 1.5, by: str = "length", order: Sequence[str] = ()) -> DataFrame:
    """Of the parallel edges between two nodes (in either direction) those go
    that are less than ``max_ratio`` times as long as the shortest; it stays. A row
    with ``copies`` stands for as many equal edges, of which one is the shortest."""
    pair = [F.least("u", "v"), F.greatest("u", "v")]
    w = Window.partitionBy(*pair).orderBy(F.col(by), "u", "v", *order)
    least = F.min(by).over(Window.partitionBy(*pair))
    long = F.col(by) >= max_ratio * F.col("_least")
    kept = edges.withColumns({"_n": F.row_number().over(w), "_least": least}).filter((F.col("_n") == 1) | long)
    if "copies" in edges.columns:
        kept = kept.withColumn("copies", F.when(long, F.col("copies")).otherwise(1))
    return kept.drop("_n", "_least")


def way_segments(ways: DataFrame, nodes: DataFrame, oneway: Column | None = None) -> DataFrame:
    """(way_id, seq, u, v) with coordinates of both ends from ways(way_id, nds) and nodes(node, x, y).

    Consecutive nodes become edges; unless ``oneway`` holds, also reversed."""
    flag = oneway if oneway is not None else F.lit(False)
    n = F.greatest(F.size("nds") - 1, F.lit(0))
    legs = F.zip_with(F.slice("nds", 1, n), F.slice("nds", 2, n), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    legs = ways.select("way_id", flag.alias("_one"), F.posexplode(legs).alias("seq", "leg")).select("way_id", "_one", "seq", "leg.u", "leg.v")
    both = legs.unionByName(legs.filter("not _one").withColumns({"u": F.col("v"), "v": F.col("u")})).drop("_one")
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    return both.join(at("u"), "u").join(at("v"), "v")


def split_ways(ways: DataFrame) -> DataFrame:
    """(way_id, part, nds): ways cut at nodes that are used more than once.

    ``nds`` is an array; inner nodes shared with any way (or met twice) end one
    part and start the next."""
    spots = ways.select("way_id", F.size("nds").alias("_size"), F.posexplode("nds").alias("pos", "node"))
    used = spots.groupBy("node").agg(F.count(F.lit(1)).alias("_used"))
    w = Window.partitionBy("way_id").orderBy("pos")
    cut = ((F.col("_used") > 1) & (F.col("pos") > 0) & (F.col("pos") < F.col("_size") - 1)).cast("int")
    placed = spots.join(used, "node").withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(w))
    doubled = placed.select("way_id", F.col("_part").alias("part"), "pos", "node").unionByName(
        placed.filter("_cut = 1").select("way_id", (F.col("_part") - 1).alias("part"), "pos", "node")
    )
    grouped = doubled.groupBy("way_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_x"))
    return grouped.select("way_id", "part", F.transform("_x", lambda s: s["node"]).alias("nds"))


def salt_long(edges: DataFrame, longest: float, by: str = "length") -> DataFrame:
    """Edges longer than ``longest`` as pieces of that length and a rest: adds
    ``piece``, ``from_len`` and ``to_len`` along the edge."""
    n = F.greatest(F.ceil(F.col(by) / F.lit(longest)).cast("int"), F.lit(1))
    return (
        edges.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("from_len", F.col("piece") * F.lit(float(longest)))
        .withColumn("to_len", F.least((F.col("piece") + 1) * F.lit(float(longest)), F.col(by)))
    )


def interior_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that simplification contracts: two neighbours and degree two or four, no loop.
    A row with ``copies`` counts as many times."""
    copies = F.col("copies") if "copies" in edges.columns else F.lit(1)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), copies.alias("_c")).union(edges.select("v", "u", copies))
    stats = ends.groupBy("node").agg(F.countDistinct("other").alias("near"), F.sum("_c").alias("degree"), F.max(F.col("node") == F.col("other")).alias("loop"))
    return stats.filter("near = 2 and degree in (2, 4) and not loop").select("node")


def node_costs_to_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds half the cost of each end node to the edge's cost; a missing node costs nothing."""
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("cost").alias(f"_{end}"))
    joined = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return joined.withColumn("cost", F.col("cost") + F.coalesce("_u", F.lit(0)) / 2 + F.coalesce("_v", F.lit(0)) / 2).drop("_u", "_v")


def disrupt_nodes(edges: DataFrame, nodes: DataFrame, risk: str, threshold: float, fail: float) -> DataFrame:
    """``cost`` becomes ``fail`` on edges at a node whose risk exceeds the threshold."""
    bad = nodes.filter(F.col(risk) > threshold).select("node").distinct()
    hit = lambda end: bad.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    joined = edges.join(hit("u"), "u", "left").join(hit("v"), "v", "left")
    return joined.withColumn("cost", F.when(F.coalesce("_u", "_v", F.lit(False)), F.lit(float(fail))).otherwise(F.col("cost"))).drop("_u", "_v")


def disrupt_random(edges: DataFrame, percent: float, seed: int, fail: float, key: str = "edge_id") -> DataFrame:
    """``cost`` becomes ``fail`` on the edges whose hashed key falls into the
    lowest ``percent`` of the hash range: the same edges for the same seed,
    without a global sort."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 10_000
    return edges.withColumn("cost", F.when(share < percent, F.lit(float(fail))).otherwise(F.col("cost")))


def contract_chains(edges: DataFrame, by: str = "length") -> DataFrame:
    """(u, v, length, parts) of undirected edges (each once) with chains of
    two-neighbour nodes drawn together: lengths add up, ``parts`` counts the edges.

    Chains are the components of the interior nodes joined by edges, so a chain
    of any length takes a few rounds, not one a node. A ring without an end, and
    an edge between two ends, stay as they are; a chain that returns to its
    start becomes a loop. Where edges have ``copies``, a row stands for as many
    equal edges, and the result has that column too."""
    many = "copies" in edges.columns
    copies, held = (F.col("copies"), ["copies"]) if many else (F.lit(1), [])
    inner = interior_nodes(edges)
    mark = lambda end: inner.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    known = edges.join(mark("u"), "u", "left").join(mark("v"), "v", "left").fillna(False, ["_u", "_v"])
    linked = connected_components(known.filter("_u and _v").select("u", "v"))
    chain = inner.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("chain"))
    of = lambda end: chain.select(F.col("node").alias(end), F.col("chain").alias(f"_c{end}"))
    placed = known.join(of("u"), "u", "left").join(of("v"), "v", "left").withColumn("chain", F.coalesce("_cu", "_cv"))
    ends = F.array_compact(F.array(F.when(~F.col("_u"), F.col("u")), F.when(~F.col("_v"), F.col("v"))))
    # An edge of a chain touches a node of degree four at most, so it has few copies.
    ends = F.flatten(F.array_repeat(ends, copies.cast("int")))
    grouped = placed.filter("chain is not null").groupBy("chain").agg(F.sum(F.col(by) * copies).alias("length"), F.sum(copies).alias("parts"), F.array_sort(F.flatten(F.collect_list(ends))).alias("_ends"))
    open_chains = grouped.filter(F.size("_ends") == 2).withColumn("copies", F.lit(1).cast("long"))
    merged = open_chains.select(F.get("_ends", F.lit(0)).alias("u"), F.get("_ends", F.lit(1)).alias("v"), "length", "parts", *held)
    plain = placed.join(open_chains.select("chain"), "chain", "left_anti").select("u", "v", F.col(by).alias("length"), F.lit(1).cast("long").alias("parts"), *held)
    return merged.unionByName(plain)


def merge_close_nodes(nodes: DataFrame, edges: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with nodes(node, x, y) within ``radius`` of each other, in
    turn, drawn together in their mean place under the smallest name; edges
    inside such a group go."""
    named = materialize(close_groups(nodes.withColumnRenamed("node", "id"), radius), "named").withColumnsRenamed({"id": "node", "group": "to"})
    at = lambda end: named.select(F.col("node").alias(end), F.col("to").alias(f"_{end}"))
    moved = edges.join(at("u"), "u").join(at("v"), "v").filter("_u <> _v").withColumns({"u": F.col("_u"), "v": F.col("_v")}).drop("_u", "_v")
    return named.groupBy(F.col("to").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")), moved


def join_networks(base: DataFrame, base_edges: DataFrame, other: DataFrame, other_edges: DataFrame, radius: float, size: float) -> DataFrame:
    """(u, v, length, kind): both networks' edges, and glue in both directions
    from each node of ``other`` to its nearest base node within ``radius``.
    Names of the second network are prefixed by "add_"."""
    name = lambda c: F.concat(F.lit("add_"), F.col(c).cast("string"))
    near = nearest_join(other.withColumnRenamed("node", "id"), base.withColumnRenamed("node", "id"), size).filter(F.col("dist") <= radius)
    glue = near.select(name("a_id").alias("u"), F.col("b_id").cast("string").alias("v"), F.col("dist").alias("length"), F.lit("glue").alias("kind"))
    own = base_edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "length", F.lit("base").alias("kind"))
    added = other_edges.select(name("u").alias("u"), name("v").alias("v"), "length", F.lit("added").alias("kind"))
    return own.unionByName(added).unionByName(reflect_all(glue))


def replace_cost(edges: DataFrame, observed: DataFrame, keys: Sequence[str], cost: str) -> DataFrame:
    """``edges`` whose ``cost`` is the observed one where the edge's keys have any; observed tells which."""
    seen = observed.select(*keys, F.col(cost).alias("_seen"))
    joined = edges.join(seen, list(keys), "left")
    return joined.withColumn("observed", F.col("_seen").isNotNull().cast("int")).withColumn(cost, F.coalesce("_seen", cost)).select(*edges.columns, "observed")


def condition_summary(edges: DataFrame, by: Sequence[str], unmeasured: str = "NOT MEASURED", classes: Sequence[str] = ("GOOD",)) -> DataFrame:
    """(*by, measured, one length a condition class, mean_iri) of edges(length, condition, iri):
    the mean roughness leaves blanks out above and keeps their length below the line."""
    known = F.col("condition") != unmeasured
    total = F.sum(F.when(known, F.col("length")))
    parts = [F.sum(F.when(F.col("condition") == c, F.col("length"))).alias(c) for c in classes]
    return edges.groupBy(*by).agg(total.alias("measured"), *parts, (F.sum(F.when(known, F.col("iri") * F.col("length"))) / total).alias("mean_iri"))


def length_by_class(edges: DataFrame) -> DataFrame:
    """(class, km) of edges(classes, length): an edge with several classes counts for its first."""
    return edges.groupBy(F.get("classes", F.lit(0)).alias("class")).agg((F.sum("length") / 1000).alias("km"))


def average_speed(edges: DataFrame) -> DataFrame:
    """(kmh) of edges(length, seconds): the whole length over the whole time."""
    return edges.agg(((F.sum("length") / 1000) / (F.sum("seconds") / 3600)).alias("kmh"))


def class_speed(edges: DataFrame) -> DataFrame:
    """(class, kmh) of edges(class, mean_speed): the mean of the positive speeds; 0 without any."""
    return edges.groupBy("class").agg(F.coalesce(F.avg(F.when(F.col("mean_speed") > 0, F.col("mean_speed"))), F.lit(0.0)).alias("kmh"))


def longest_part(parts: Column) -> Column:
    """The longest of array<struct<length, part>>; of equal ones the last."""
    return F.array_max(parts)


def clip_edges(edges: DataFrame, ring: Column) -> DataFrame:
    """edges(u, v, x1, y1, x2, y2) cut to a convex, counter-clockwise, closed ring:
    edges outside go, those across its border get new ends; kept tells the share left."""
    c = F.col
    part = edges.withColumn("_t", clip_segment(c("x1"), c("y1"), c("x2"), c("y2"), ring)).filter("_t is not null")
    at = lambda a, b, t: c(a) + c(f"_t.{t}") * (c(b) - c(a))
    moved = {"x1": at("x1", "x2", "t0"), "y1": at("y1", "y2", "t0"), "x2": at("x1", "x2", "t1"), "y2": at("y1", "y2", "t1")}
    return part.withColumns({**{f"_{k}": v for k, v in moved.items()}, "kept": c("_t.t1") - c("_t.t0")}).select(
        *(c(f"_{k}").alias(k) if k in moved else c(k) for k in edges.columns), "kept"
    )


def name_ends(edges: DataFrame, nodes: DataFrame, digits: int = 10) -> DataFrame:
    """``edges`` with u and v by the place of their ends: the node(node, x, y) there,
    to ``digits`` decimals, or a new name made of the place."""
    spot = lambda x, y: F.concat_ws(":", F.round(x, digits), F.round(y, digits))
    known = nodes.groupBy(spot(F.col("x"), F.col("y")).alias("_spot")).agg(F.min(F.col("node").cast("string")).alias("_node"))
    out = edges
    for end, k in (("u", 1), ("v", 2)):
        out = out.withColumn("_spot", spot(F.col(f"x{k}"), F.col(f"y{k}"))).join(known, "_spot", "left")
        out = out.withColumn(end, F.coalesce("_node", F.concat(F.lit("new_node_"), F.col("_spot")))).drop("_spot", "_node")
    return out


def split_border_nodes(edges: DataFrame, borders: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """edges(u, v, cost, country) whose border nodes(node) that trips start or end at
    are split: edges of a country meet its own copy "<node>|<country>", and each
    copy is tied to the node itself, both ways, at a cost of ``epsilon``."""
    at = lambda end: borders.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    own = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    name = lambda end: F.when(F.col(f"_{end}"), F.concat_ws("|", end, "country")).otherwise(F.col(end).cast("string"))
    moved = own.select(name("u").alias("u"), name("v").alias("v"), "cost", F.lit("line").alias("kind"))
    copies = own.filter("_u").select(F.col("u").alias("node"), "country").union(own.filter("_v").select("v", "country")).distinct()
    ties = copies.select(F.concat_ws("|", "node", "country").alias("u"), F.col("node").cast("string").alias("v"), F.lit(float(epsilon)).alias("cost"), F.lit("tie").alias("kind"))
    return moved.unionByName(reflect_all(ties))


def multimodal(parts: dict[str, DataFrame], boarding: float = 0.0) -> DataFrame:
    """(u, v, seconds, mode) of the edges(u, v, seconds) of several modes in one network; all but walking cost ``boarding`` more."""
    every = None
    for mode, edges in parts.items():
        one = edges.select("u", "v", (F.col("seconds") + (0.0 if mode == "walk" else boarding)).alias("seconds"), F.lit(mode).alias("mode"))
        every = one if every is None else every.unionByName(one)
    return every


def dissolve(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(<key>, cx, cy): the cells, ``size`` wide, whose centres lie in any polygon(<key>, ring or rings) of the key, each once."""
    return dissolved_cells(polygons, key, size)


def overlay(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, area, ring) of the common parts of a(id, ring) and b(id, ring), the
    latter convex and counter-clockwise; they meet where their coverings do.
    Equal shapes are laid over each other once."""
    (one, of_a), (two, of_b) = distinct_shapes(a, ["id"]), distinct_shapes(b, ["id"])
    pairs = touching_pairs(one.withColumnRenamed("shape", "id"), two.withColumnRenamed("shape", "id"), size)
    met = pairs.join(one.select(F.col("shape").alias("a_id"), F.col("ring").alias("a_ring")), "a_id").join(two.select(F.col("shape").alias("b_id"), F.col("ring").alias("b_ring")), "b_id")
    # Clipping is much work for few bytes, so the number of tasks is given.
    met = met.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = met.select(F.col("a_id").alias("_a"), F.col("b_id").alias("_b"), clip_ring(F.col("a_ring"), F.col("b_ring")).alias("ring"))
    cut = materialize(cut.withColumn("area", F.abs(ring_area(F.col("ring")))).filter("area > 1e-12"), "common")
    named = cut.join(of_b.select(F.col("id").alias("b_id"), F.col("shape").alias("_b")), "_b")
    return of_a.select(F.col("id").alias("a_id"), F.col("shape").alias("_a")).join(named, "_a").select("a_id", "b_id", "area", "ring")


def clustering(edges: DataFrame) -> DataFrame:
    """(u, pairs, closed, clustering) of the undirected graph of edges(u, v): the share
    of each node's pairs of neighbours that are neighbours of each other.

    Each edge points to its end of higher degree, so a hub lists few edges of its
    own; triangles are found once, from their lowest node, and count for all three."""
    both = edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select("v", "u")).distinct()
    degree = materialize(both.groupBy("u").agg(F.count(F.lit(1)).alias("degree")), "degree")
    at = lambda end: degree.select(F.col("u").alias(end), F.struct("degree", F.col("u").alias("node")).alias(f"_{end}"))
    up = materialize(both.join(at("u").withColumnRenamed("u", "_n"), F.col("u") == F.col("_n")).drop("_n").join(at("v"), "v").filter("_u < _v").select("u", "v", "_v"), "oriented")
    wedge = up.select("u", F.col("v").alias("x"), F.col("_v").alias("_x")).join(up.select("u", F.col("v").alias("y"), F.col("_v").alias("_y")), "u").filter("_x < _y")
    closed = wedge.join(up.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    hits = closed.select(F.explode(F.array("u", "x", "y")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("closed"))
    out = degree.filter("degree > 1").join(hits, "u", "left")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("u", pairs.cast("long").alias("pairs"), F.coalesce("closed", F.lit(0)).alias("closed"), (F.coalesce("closed", F.lit(0)) / pairs).alias("clustering"))
