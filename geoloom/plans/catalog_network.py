"""Further registered queries: components, graph edits, polygons, surfaces and what is routed on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import access, demand, graph, raster, routing, spatial
from geoloom.operators.components import largest_component, strong_components
from geoloom.plans.catalog import _CUSTOMERS, _GRID, _SUPPLIERS, BACK, NG3, OD, PATHS, _grid, _points, _r, ng3, ng3_od, query
from geoloom.sources.tables import table

_LON, _LAT = "((%s * 37) %% 360 - 180)::double", "((%s * 17) %% 180 - 90)::double"
SEGMENTS = NG3 + f", seg as (select u, v, cost, {_LON % 'u'} as x1, {_LAT % 'u'} as y1, {_LON % 'v'} as x2, {_LAT % 'v'} as y2 from ng3)"


def segments(spark, sf) -> DataFrame:
    """NG3 with the places of both ends."""
    place = {"x1": geo.synthetic_lon(F.col("u")), "y1": geo.synthetic_lat(F.col("u")), "x2": geo.synthetic_lon(F.col("v")), "y2": geo.synthetic_lat(F.col("v"))}
    return ng3(spark, sf).select("u", "v", "cost", *(c.alias(k) for k, c in place.items()))


# --- components ------------------------------------------------------------------------

_REACH = NG3 + ", r(a, b) as (select u, v from ng3 union select r.a, e.v from r join ng3 e on e.u = r.b), n as (select u as node from ng3 union select v from ng3), scc as (select node, least(node, coalesce((select min(f.b) from r f join r g on g.a = f.b and g.b = f.a where f.a = node), node)) as component from n)"
_BEST = _REACH + ", best as (select component from scc group by 1 order by count(*) desc, component limit 1), inside as (select node from scc where component = (select component from best))"


@query("with recursive " + _REACH + " select node, component from scc")
def strong_component_labels(spark, sf):
    return strong_components(ng3(spark, sf))


@query("with recursive " + _BEST + " select u, v, round(cost, 6) as cost from ng3 where u in (select node from inside) and v in (select node from inside)")
def largest_strong_component(spark, sf):
    return largest_component(ng3(spark, sf).select("u", "v", F.round("cost", 6).alias("cost")), strong=True)


@query("with recursive " + _BEST + """, e as (select u, v, cost from ng3 where u in (select node from inside) and v in (select node from inside)), walk as (select distinct u as o, u as node, 0.0::double as cost, 0 as hops from e
union all select w.o, e.v, w.cost + e.cost, w.hops + 1 from walk w join e on e.u = w.node where w.hops < 8) select o, node as d, round(min(cost), 6) as cost from walk group by 1, 2""")
def od_on_largest_component(spark, sf):
    e = largest_component(ng3(spark, sf), strong=True)
    return routing.od_matrix(e, e.select(F.col("u").alias("o")), e.select(F.col("u").alias("d"))).withColumn("cost", F.round("cost", 6))


# --- graph edits -----------------------------------------------------------------------------


@query("""with l as (select p_partkey, p_size::double as s, (p_partkey % 2) * p_size + 0.4 * p_size as d from part) select p_partkey, round(d, 6) as first, round(2 * s - d, 6) as second, round(least(d, s), 6) as x, round(greatest(d - s, 0), 6) as y from l""")
def cut_lines(spark, sf):
    """Lines of two legs cut at a distance: the lengths of both parts and the place of the cut."""
    s = F.col("p_size").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = table(spark, sf, "part").withColumn("line", F.array(at(F.lit(0.0), F.lit(0.0)), at(s, F.lit(0.0)), at(s, s)))
    a, b = geo.cut_line(F.col("line"), F.col("p_partkey") % 2 * s + 0.4 * s)
    out = p.select("p_partkey", a.alias("a"), b.alias("b"))
    spot = F.get("b", F.lit(0))
    return out.select("p_partkey", F.round(geo.planar_length(F.col("a")), 6).alias("first"), F.round(geo.planar_length(F.col("b")), 6).alias("second"), F.round(spot["x"], 6).alias("x"), F.round(spot["y"], 6).alias("y"))


@query("""select p_partkey, round(0.8 * p_size, 6) as head, round(0.8 * p_size, 6) as middle, round(0.4 * p_size, 6) as tail from part""")
def line_parts(spark, sf):
    """The first 40 % of a line, its last 20 %, and what lies between."""
    s = F.col("p_size").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = table(spark, sf, "part").withColumn("line", F.array(at(F.lit(0.0), F.lit(0.0)), at(s, F.lit(0.0)), at(s, s)))
    head, rest = geo.cut_line(F.col("line"), geo.planar_length(F.col("line")) * 0.4)
    p = p.select("p_partkey", head.alias("head"), rest.alias("rest"))
    middle, tail = geo.cut_line(F.col("rest"), geo.planar_length(F.col("rest")) * (2 / 3))
    p = p.select("p_partkey", "head", middle.alias("middle"), tail.alias("tail"))
    return p.select("p_partkey", *(F.round(geo.planar_length(F.col(c)), 6).alias(c) for c in ("head", "middle", "tail")))


_BOX = (-100.0, -50.0, 100.0, 50.0)
_T = """, q as (select *, x2 - x1 as dx, y2 - y1 as dy from seg), t as (select *,
greatest(0.0, case when dx > 0 then (-100 - x1) / dx when dx < 0 then (100 - x1) / dx when x1 < -100 or x1 > 100 then 2 else 0 end, case when dy > 0 then (-50 - y1) / dy when dy < 0 then (50 - y1) / dy when y1 < -50 or y1 > 50 then 2 else 0 end) as t0,
least(1.0, case when dx > 0 then (100 - x1) / dx when dx < 0 then (-100 - x1) / dx else 1 end, case when dy > 0 then (50 - y1) / dy when dy < 0 then (-50 - y1) / dy else 1 end) as t1 from q),
cut as (select u, v, x1 + t0 * dx as x1, y1 + t0 * dy as y1, x1 + t1 * dx as x2, y1 + t1 * dy as y2, t1 - t0 as kept from t where t0 < t1)"""


@query("with " + SEGMENTS + _T + " select u, v, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2, round(kept, 6) as kept from cut")
def clip_graph(spark, sf):
    """Edges cut to a polygon."""
    out = graph.clip_edges(segments(spark, sf).drop("cost"), geo.box_ring(*_BOX))
    return out.select("u", "v", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "kept")))


@query("with " + SEGMENTS + _T + """ select cast(count(*) as bigint) as edges, cast(sum(case when round(x1, 6) in (select round(x1, 6) from seg s where s.u = cut.u) and kept = 1 then 1 else 0 end) as bigint) as whole from cut""")
def clipped_ends(spark, sf):
    """Clipped edges whose ends are named anew where no node lies: how many there are, and how many still join known nodes."""
    e = segments(spark, sf)
    nodes = e.select(F.col("u").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(e.select("v", "x2", "y2")).distinct()
    named = graph.name_ends(graph.clip_edges(e, geo.box_ring(*_BOX)), nodes)
    old = ~F.col("u").startswith("new_node_") & ~F.col("v").startswith("new_node_")
    return named.agg(F.count(F.lit(1)).alias("edges"), F.sum(old.cast("long")).alias("whole"))


@query("with " + SEGMENTS + """, f as (select *, (abs(x1) < 100 and abs(y1) < 50) as a, (abs(x2) < 100 and abs(y2) < 50) as b from seg) select u, v, cast(a and b as int) as contained, cast(a or b as int) as touched from f where a or b""")
def edges_in_polygon(spark, sf):
    """Edges with both ends, or either, inside a polygon."""
    e = segments(spark, sf)
    inside = lambda k: geo.point_in_ring(F.col(f"x{k}"), F.col(f"y{k}"), geo.box_ring(*_BOX))
    f = e.select("u", "v", inside(1).alias("a"), inside(2).alias("b")).filter("a or b")
    return f.select("u", "v", (F.col("a") & F.col("b")).cast("int").alias("contained"), F.lit(1).alias("touched"))


@query("with " + SEGMENTS + " select u, v, round(radians(x1) * 6378137.0, 3) as x1, round(ln(tan(pi() / 4 + radians(y1) / 2)) * 6378137.0, 3) as y1, round(radians(x2) * 6378137.0, 3) as x2, round(ln(tan(pi() / 4 + radians(y2) / 2)) * 6378137.0, 3) as y2 from seg where abs(y1) < 89 and abs(y2) < 89")
def reproject_graph(spark, sf):
    e = segments(spark, sf).filter("abs(y1) < 89 and abs(y2) < 89")
    a, b = geo.web_mercator(F.col("x1"), F.col("y1")), geo.web_mercator(F.col("x2"), F.col("y2"))
    return e.select("u", "v", *(F.round(c, 3).alias(k) for k, c in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True)))


@query("with " + NG3 + """, e as (select u, v, cost, u % 5 as country from ng3), b as (select n_nationkey as node from nation where n_nationkey % 4 = 0), m as (select case when u in (select node from b) then u || '|' || country else u::varchar end as u, case when v in (select node from b) then v || '|' || country else v::varchar end as v, cost, 'line' as kind from e),
c as (select u as node, country from e where u in (select node from b) union select v, country from e where v in (select node from b))
select u, v, round(cost, 6) as cost, kind from m union all select node || '|' || country, node::varchar, 0.000001, 'tie' from c union all select node::varchar, node || '|' || country, 0.000001, 'tie' from c""")
def border_nodes_split(spark, sf):
    e = ng3(spark, sf).select("u", "v", F.round("cost", 6).alias("cost"), (F.col("u") % 5).alias("country"))
    b = table(spark, sf, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("node"))
    return graph.split_border_nodes(e, b)


@query("with " + NG3 + """, m as (select u, v, round(cost * 60 + 30, 4) as seconds, 'transit' as mode from ng3 union all select s_nationkey, c_nationkey, round(count(*) * 5.0, 4), 'walk' from supplier join customer on s_suppkey % 25 = c_custkey % 25 group by 1, 2) select * from m""")
def multimodal_edges(spark, sf):
    transit = ng3(spark, sf).select("u", "v", (F.col("cost") * 60).alias("seconds"))
    s, c = table(spark, sf, "supplier").withColumn("k", F.col("s_suppkey") % 25), table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 25)
    walk = s.groupBy("k", "s_nationkey").count().join(c.groupBy("k", "c_nationkey").agg(F.count(F.lit(1)).alias("m")), "k")
    walk = walk.groupBy(F.col("s_nationkey").alias("u"), F.col("c_nationkey").alias("v")).agg((F.sum(F.col("count") * F.col("m")) * 5.0).alias("seconds"))
    return graph.multimodal({"transit": transit, "walk": walk}, 30.0).withColumn("seconds", _r("seconds"))


@query("""select cast(p_partkey // 10 * 10 as bigint) as u, cast(p_partkey // 10 * 10 + 9 as bigint) as v, round(sum(p_size), 4) as length, count(*) as parts from part where p_partkey % 10 < 9 group by 1, 2""")
def contracted_chains(spark, sf):
    """Chains of nodes with two neighbours drawn together."""
    e = table(spark, sf, "part").filter("p_partkey % 10 < 9").select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"), F.col("p_size").cast("double").alias("length"))
    return graph.contract_chains(e).withColumn("length", _r("length"))


_WAYS = "w as (select s_suppkey as way_id, [s_suppkey * 3, s_suppkey * 3 + 1, s_suppkey * 3 + 2, s_suppkey * 3 + 3] || case when s_suppkey % 3 = 0 then [s_suppkey * 3 + 7] else [] end as nds from supplier)"


def _ways(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    nds = F.concat(F.array(k * 3, k * 3 + 1, k * 3 + 2, k * 3 + 3), F.when(k % 3 == 0, F.array(k * 3 + 7)).otherwise(F.array().cast("array<bigint>")))
    return table(spark, sf, "supplier").select(k.alias("way_id"), nds.alias("nds"))


@query(f"with {_WAYS}, s as (select way_id, len(nds) as n, unnest(nds) as node, generate_subscripts(nds, 1) - 1 as pos from w), c as (select *, case when count(*) over (partition by node) > 1 and pos > 0 and pos < n - 1 then 1 else 0 end as cut from s), p as (select *, sum(cut) over (partition by way_id order by pos) as part from c), d as (select way_id, part, pos, node from p union all select way_id, part - 1, pos, node from p where cut = 1) select way_id, cast(part as bigint) as part, string_agg(node::varchar, '-' order by pos) as nds from d group by 1, 2")
def split_way_parts(spark, sf):
    return graph.split_ways(_ways(spark, sf)).select("way_id", F.col("part").cast("long").alias("part"), F.concat_ws("-", F.col("nds").cast("array<string>")).alias("nds"))


@query(f"with {_WAYS}, s as (select way_id, unnest(nds) as u, unnest(nds[2:]) as v, generate_subscripts(nds, 1) - 1 as seq from w), e as (select way_id, cast(seq as int) as seq, u, v from s where v is not null) select * from e union all select way_id, seq, v, u from e where way_id % 2 = 0")
def way_edges(spark, sf):
    """The edges of ways, both directions unless one-way."""
    w = _ways(spark, sf)
    nodes = w.select(F.explode("nds").alias("node")).distinct().select("node", geo.synthetic_lon(F.col("node")).alias("x"), geo.synthetic_lat(F.col("node")).alias("y"))
    return graph.way_segments(w, nodes, F.col("way_id") % 2 == 1).select("way_id", "seq", "u", "v")


@query(f"""with s as ({_SUPPLIERS}), n as (select n_nationkey as id, {_LON % 'n_nationkey'} as x, {_LAT % 'n_nationkey'} as y from nation), d as (select s.id as a, n.id as b, sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)) as dist from s, n), k as (select * from (select *, row_number() over (partition by a order by dist, b) as r from d) where r = 1 and dist <= 20)
select 'add_' || a as u, b::varchar as v, round(dist, 4) as length from k union all select b::varchar, 'add_' || a, round(dist, 4) from k""")
def glued_networks(spark, sf):
    """The glue between two networks: each added node's nearest base node within reach, both ways."""
    base = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), geo.synthetic_lon(F.col("n_nationkey")).alias("x"), geo.synthetic_lat(F.col("n_nationkey")).alias("y"))
    other = _points(spark, sf, "supplier", "s_suppkey").withColumnRenamed("id", "node")
    none = spark.createDataFrame([], "u long, v long, length double")
    return graph.join_networks(base, none, other, none, 20.0, 20.0).filter("kind = 'glue'").select("u", "v", _r("length").alias("length"))


# --- polygons --------------------------------------------------------------------------------

_PARCELS = "p as (select p_partkey as id, (p_partkey * 7) % 100 + 0.5 as x, (p_partkey * 13) % 100 + 0.25 as y, p_size / 5.0 as s, p_size from part)"


def _parcels(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), ((k * 7) % 100 + 0.5).alias("x"), ((k * 13) % 100 + 0.25).alias("y"), (F.col("p_size") / 5.0).alias("s"), "p_size", "p_type")
    return p.withColumn("ring", geo.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")))


_ZONES = "z as (select n_nationkey as zone, (n_nationkey % 5) * 20.0 as zx, (n_nationkey // 5) * 20.0 as zy from nation)"


def _zones(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k % 5) * 20.0, F.floor(k / 5) * 20.0
    return table(spark, sf, "nation").select(k.alias("id"), geo.box_ring(x, y, x + 20, y + 20).alias("ring"), x.alias("zx"), y.alias("zy"))


@query(f"with {_PARCELS}, {_ZONES}, o as (select zone as b_id, id as a_id, greatest(0, least(x + s, zx + 20) - greatest(x, zx)) * greatest(0, least(y + s, zy + 20) - greatest(y, zy)) as area from p, z) select a_id, b_id, round(area, 6) as area from o where area > 1e-12")
def polygon_overlay(spark, sf):
    """Areas that parcels and zones have in common."""
    return graph.overlay(_parcels(spark, sf), _zones(spark, sf), 20.0).select("a_id", "b_id", F.round("area", 6).alias("area"))


@query(f"""with {_PARCELS}, {_ZONES} select zone, count(*) as met, cast(count(*) filter (where x >= zx and y >= zy and x + s <= zx + 20 and y + s <= zy + 20) as bigint) as contained, cast(count(*) filter (where s * s > 36) as bigint) as large
from z join p on x < zx + 20 and x + s > zx and y < zy + 20 and y + s > zy group by 1""")
def parcel_counts(spark, sf):
    """Parcels that meet each zone, lie wholly inside, and are large."""
    p = _parcels(spark, sf)
    met = graph.overlay(p, _zones(spark, sf), 20.0).join(p.select(F.col("id").alias("a_id"), F.pow("s", 2).alias("whole")), "a_id")
    inside = F.abs(F.col("area") - F.col("whole")) < 1e-9
    return met.groupBy(F.col("b_id").alias("zone")).agg(F.count(F.lit(1)).alias("met"), F.sum(inside.cast("long")).alias("contained"), F.sum((F.col("whole") > 36).cast("long")).alias("large"))


@query(f"with {_PARCELS}, t as (select p_type, x, y, s from p join part on p_partkey = id), c as (select distinct p_type, cx, cy from t, (select unnest(generate_series(0, 120)) as cx), (select unnest(generate_series(0, 120)) as cy) where cx + 0.5 >= x and cx + 0.5 < x + s and cy + 0.5 >= y and cy + 0.5 < y + s) select p_type, count(*) as cells from c group by 1")
def dissolved_area(spark, sf):
    """Area, in unit cells, of the parcels of each type laid together: what overlaps counts once."""
    return graph.dissolve(_parcels(spark, sf), "p_type", 1.0).groupBy("p_type").agg(F.count(F.lit(1)).alias("cells"))


@query("with " + SEGMENTS + """, s as (select u * 100 + v as id, * from seg), h as (select a.id as a_id, b.id as b_id, b.cost as cost, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) as t,
((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) as s from s a join s b on a.id < b.id)
select a_id, count(*) as crossings, round(min(cost), 6) as cost from h where t between 0 and 1 and s between 0 and 1 group by 1""")
def attributes_by_crossing(spark, sf):
    """Edges take an attribute of the lines that cross or touch them (of those with a larger name)."""
    s = segments(spark, sf).withColumn("id", F.col("u") * 100 + F.col("v"))
    hit = spatial.segment_crossings(s.select("id", "x1", "y1", "x2", "y2"), 60.0)
    return hit.join(s.select(F.col("id").alias("b_id"), "cost"), "b_id").groupBy("a_id").agg(F.count(F.lit(1)).alias("crossings"), F.round(F.min("cost"), 6).alias("cost"))


# --- routing ------------------------------------------------------------------------------------


@query("with recursive " + BACK + ", f as (select u, v, count(*)::double as flow from back group by 1, 2) select u, v, round(flow / (select count(*) from back where seq = 0), 6) as betweenness from f")
def edge_betweenness(spark, sf):
    """Share of all trips that use each edge."""
    e = ng3(spark, sf)
    paths = routing.shortest_paths(e, e.select(F.col("u").alias("o")))
    trips = paths.filter("hops > 0").select("o", F.col("node").alias("d"), F.lit(1.0).alias("flow"))
    return demand.betweenness(routing.assign_flows(paths, trips), trips).select("u", "v", F.round("betweenness", 6).alias("betweenness"))


# Simple paths of up to six edges bound the third best of a pair; then all simple paths grow whose cheapest end keeps to it.
_SIMPLE = PATHS + """, least as materialized (select o, node, cost from paths),
few(o, d, cost, path) as (select u, v, cost, [u, v] from ng3 union all select f.o, e.v, f.cost + e.cost, list_append(f.path, e.v) from few f join ng3 e on e.u = f.d where len(f.path) <= 6 and not list_contains(f.path, e.v)),
third as materialized (select o, d, max(cost) as worst from (select * from few qualify row_number() over (partition by o, d order by cost, len(path), path) <= 3) group by 1, 2 having count(*) = 3),
ends as materialized (select distinct a.u as o, b.u as d from ng3 a, ng3 b where a.u <> b.u),
grow(o, d, here, cost, path) as (select o, d, o, 0.0::double, [o] from ends union all select g.o, g.d, e.v, g.cost + e.cost, list_append(g.path, e.v) from grow g join ng3 e on e.u = g.here join least l on l.o = e.v and l.node = g.d left join third t on t.o = g.o and t.d = g.d
  where g.here <> g.d and not list_contains(g.path, e.v) and (t.worst is null or g.cost + e.cost + l.cost <= t.worst + 1e-9)),
best as (select o, d, cost, path, row_number() over (partition by o, d order by cost, len(path), path) as rank from grow where here = d)"""


def _three_paths(spark, sf) -> DataFrame:
    """The three cheapest loopless paths of every pair of nations that trade."""
    e = ng3(spark, sf).select("u", "v", "cost")
    ends = e.select(F.col("u").alias("o")).distinct()
    return routing.k_paths(e, ends.join(ends.select(F.col("o").alias("d")), F.col("o") != F.col("d")), 3)


@query("with recursive " + _SIMPLE + " select o, d, cast(rank as int) as rank, round(cost, 6) as cost, array_to_string(path, '-') as path from best where rank <= 3")
def k_shortest_paths(spark, sf):
    p = _three_paths(spark, sf)
    return p.select("o", "d", "rank", F.round("cost", 6).alias("cost"), F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


@query("with recursive " + _SIMPLE + """, k as (select * from best where rank <= 3), f as (select *, row_number() over (partition by o, d, round(cost, 9) order by rank) as n from k)
select o, d, cast(rank as int) as rank, round(exp(-0.05 * cost) / sum(exp(-0.05 * cost)) over (partition by o, d), 6) as share from f where n = 1""")
def logit_shares(spark, sf):
    """Trips split over the paths of a pair by a logit of their costs."""
    return routing.logit_split(_three_paths(spark, sf)).select("o", "d", "rank", F.round("share", 6).alias("share"))


@query("with recursive " + OD + f", t as (select o, node, threshold, cast(floor({_LON % 'node'} / 20) as bigint) as cx, cast(floor({_LAT % 'node'} / 20) as bigint) as cy from paths, (values (20.0::double), (60.0)) v(threshold) where cost <= threshold), c as (select distinct o, threshold, cx + a as cx, cy + b as cy from t, (values (-1), (0), (1)) p(a), (values (-1), (0), (1)) q(b)) select o, threshold, count(*) as cells, min(cx) as west, max(cx) as east, min(cy) as south, max(cy) as north from c group by 1, 2")
def isochrone_areas(spark, sf):
    """The area within each threshold of an origin: the cells around the nodes reached, with their extent."""
    e = ng3(spark, sf)
    paths = routing.shortest_paths(e, e.select(F.col("u").alias("o")))
    nodes = paths.select("node").distinct().select("node", geo.synthetic_lon(F.col("node")).alias("x"), geo.synthetic_lat(F.col("node")).alias("y"))
    cells = routing.isochrone_cells(paths, nodes, [20, 60], 20.0, 1)
    ends = {"west": F.min("cx"), "east": F.max("cx"), "south": F.min("cy"), "north": F.max("cy")}
    return cells.groupBy("o", "threshold").agg(F.count(F.lit(1)).alias("cells"), *(v.alias(k) for k, v in ends.items()))


@query("with recursive " + BACK + """, e as (select u, v, cost, u % 3 = 0 as rural, case when v % 2 = 0 then 30.0 + v else 0 end as seen from ng3), b as (select o, d, back.u, back.v, e.cost, case when seen > 0 and rural then e.cost * 3600 - e.cost * 40 / 50.0 * 3600 else 0 end as saved, e.cost * 40 as km, case when seen > 0 then seen else 40 end as speed from back join e on e.u = back.u and e.v = back.v)
select o, d, count(*) as edges, round(sum(cost), 6) as cost, round(sum(saved), 4) as saved, round(sum(speed * km) / sum(km), 6) as mean_speed from b group by 1, 2""")
def route_improvement(spark, sf):
    """Per route: its edges, cost, the seconds saved if observed rural edges ran at the class speed, and the length-weighted speed."""
    e = ng3(spark, sf)
    paths = routing.shortest_paths(e, e.select(F.col("u").alias("o")))
    steps = routing.path_edges(paths, paths.filter("hops > 0").select("o", F.col("node").alias("d")))
    seen = F.when(F.col("v") % 2 == 0, 30.0 + F.col("v")).otherwise(0.0)
    known = e.select("u", "v", "cost", (F.col("cost") * 3600).alias("seconds"), (F.col("cost") * 40).alias("km"), (F.col("u") % 3 == 0).alias("rural"), seen.alias("seen"), F.lit(50.0).alias("class_speed"), F.lit(40.0).alias("speed"))
    out = routing.route_improvement(steps, known)
    return out.select("o", "d", "edges", F.round("cost", 6).alias("cost"), _r("saved").alias("saved"), F.round("mean_speed", 6).alias("mean_speed"))


@query("with recursive " + OD + """, w as (select o, o % 7 * 2.0 as direct, w_d, d, cost + d % 4 as total from od where o <> d), m as (select o, direct, min(total) as net from w group by 1, 2)
select o, round(net, 6) as net, round(least(net, direct), 6) as best, case when direct <= net then 'walk' else 'net' end as mode from m""")
def od_with_walks(spark, sf):
    """The nearest destination by network and the walk at its end, against walking all the way."""
    od = ng3_od(spark, sf).filter("o <> d")
    legs = od.select("d").distinct().withColumn("walk", (F.col("d") % 4).cast("double"))
    direct = od.select("o").distinct().withColumn("direct", F.col("o") % 7 * 2.0)
    return access.with_walks(od, legs, direct).select("o", F.round("net", 6).alias("net"), F.round("best", 6).alias("best"), "mode")


@query("with recursive " + OD + " select o, arg_min(d, (cost, d)) as d, round(min(cost), 6) as cost from od where o <> d and o % 5 = d % 5 group by 1")
def region_nearest(spark, sf):
    """The nearest destination in the origin's own region."""
    od = ng3_od(spark, sf).filter("o <> d")
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 5).alias("region"))
    return access.nearest_in_region(od, regions).withColumn("cost", F.round("cost", 6))


# --- surfaces --------------------------------------------------------------------------------------


@query(f"with {_GRID}, z as (select distinct cx, cy, cx % 4 + 10 as zone from g), m as (select cx, cy from g where (cx + cy) % 2 = 0), k as (select * from g join m using (cx, cy) where value <= 20000) select zone, count(value) as n, round(coalesce(sum(value), -1), 2) as total, round(coalesce(max(value), -1), 2) as high from z left join k using (cx, cy) group by 1")
def zonal_stats_masked(spark, sf):
    g = _grid(spark, sf)
    out = raster.masked_stats(g, g.select("cx", "cy", (F.col("cx") % 4 + 10).alias("zone")), g.filter("(cx + cy) % 2 = 0"), 20_000)
    return out.select("zone", "n", F.round("total", 2).alias("total"), F.round("high", 2).alias("high"))


@query(f"with {_GRID}, b as (select cx, cy, cx % 3 as zone, greatest(value, 0) as pop, case when cy % 5 <> 0 then abs(cx * 7 + cy * 3) % 300 * 1.0 end as secs from g) select zone, round(sum(pop), 2) as pop, round(coalesce(sum(case when secs <= 60 then pop end), 0), 2) as within_60, round(coalesce(sum(case when secs <= 60 then pop end), 0) / nullif(sum(pop), 0), 6) as share_60, round(sum(pop) - coalesce(sum(case when secs <= 240 then pop end), 0), 2) as beyond from b group by 1")
def pop_within_times(spark, sf):
    """People of each zone within travel times, of a surface with two bands."""
    g = _grid(spark, sf)
    bands = g.select("cx", "cy", F.greatest("value", F.lit(0.0)).alias("pop"), F.when(F.col("cy") % 5 != 0, F.abs(F.col("cx") * 7 + F.col("cy") * 3) % 300 * 1.0).alias("seconds"))
    out = raster.population_within(bands, g.select("cx", "cy", (F.col("cx") % 3).alias("zone")), [30, 60, 120, 240])
    return out.select("zone", F.round("pop", 2).alias("pop"), F.round("within_60", 2).alias("within_60"), F.round("share_60", 6).alias("share_60"), F.round("beyond", 2).alias("beyond"))


@query(f"with {_GRID}, n as (select distinct cast(floor(cx / 2.0) as bigint) as nx, cast(floor(cy / 2.0) as bigint) as ny from g) select nx as cx, ny as cy, round(value, 2) as value from n join g on g.cx = floor((nx + 0.5) * 2) and g.cy = floor((ny + 0.5) * 2)")
def resampled_nearest(spark, sf):
    return raster.resample_nearest(_grid(spark, sf), 2.0).withColumn("value", F.round("value", 2))


@query(f"""with {_GRID}, s as (select id, x / 12 - 0.5 as x, y / 12 - 0.5 as y from ({_SUPPLIERS})), f as (select id, floor(x) + a as cx, floor(y) + b as cy, (case when a = 1 then x - floor(x) else 1 - x + floor(x) end) * (case when b = 1 then y - floor(y) else 1 - y + floor(y) end) as w from s, (values (0), (1)) p(a), (values (0), (1)) q(b))
select s.id, round(sum(w * value) / nullif(sum(case when value is not null then w end), 0), 4) as value from s left join (f join g using (cx, cy)) on f.id = s.id group by 1""")
def sampled_bilinear(spark, sf):
    p = _points(spark, sf, "supplier", "s_suppkey").select("id", (F.col("x") / 12).alias("x"), (F.col("y") / 12).alias("y"))
    return raster.sample_bilinear(_grid(spark, sf), p).select("id", _r("value").alias("value"))


@query(f"with {_GRID}, l as (select cx, cy, cx * 1.0 + cy as low from g where cx % 2 = 0) select cx, cy, round(coalesce(case when value >= 0 then value end, low), 2) as value from g full join l using (cx, cy)")
def elevation_with_fallback(spark, sf):
    g = _grid(spark, sf)
    return raster.with_fallback(g, g.filter("cx % 2 = 0").select("cx", "cy", (F.col("cx") * 1.0 + F.col("cy")).alias("value"))).withColumn("value", F.round("value", 2))


@query(f"with {_GRID} select cx, cy, round(case when cx < 3 then value else -1.0 end, 2) as value from g")
def mosaic_surface(spark, sf):
    """Overlapping surfaces as one, the first on top; this also clips by a mask of cells."""
    g = _grid(spark, sf)
    return raster.mosaic(g.filter("cx < 3"), g.withColumn("value", F.lit(-1.0))).withColumn("value", F.round("value", 2))


_CLASS = "k as (select cx, cy, case when value > 5000 then 2 when value > 0 then 1 else 0 end as value, (cx + 1000) * 100000 + cy + 1000 as c from g)"


@query(f"with recursive {_GRID}, {_CLASS}, r(c, seen) as (select c, c from k union select b.c, r.seen from r join k a on a.c = r.c join k b on b.value = a.value and abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1), l as (select c, min(seen) as root from r group by 1), p as (select root, value, count(*) as cells from k join l using (c) group by 1, 2) select value, count(*) as patches, max(cells) as largest from p group by 1")
def surface_patches(spark, sf):
    """Contiguous cells of one value as patches: their number and the largest, by value."""
    k = _grid(spark, sf).select("cx", "cy", F.when(F.col("value") > 5000, 2).when(F.col("value") > 0, 1).otherwise(0).alias("value"))
    p = raster.equal_patches(k).groupBy("patch", "value").agg(F.count(F.lit(1)).alias("cells"))
    return p.groupBy("value").agg(F.count(F.lit(1)).alias("patches"), F.max("cells").alias("largest"))


def _vote(k: int) -> str:
    return f"s{k} as (select a.cx, a.cy, case when 2 * sum(b.value) > count(*) then 1 when 2 * sum(b.value) < count(*) then 0 else a.value end as value from s{k - 1} a join s{k - 1} b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 group by a.cx, a.cy, a.value)"


@query(f"with {_GRID}, s0 as (select cx, cy, cast(value > 4000 as int) as value from g), " + ", ".join(_vote(k) for k in range(1, 4)) + " select cx, cy, cast(value as int) as value from s3")
def smoothed_surface(spark, sf):
    """Three rounds of a majority filter."""
    return raster.smooth(_grid(spark, sf).select("cx", "cy", (F.col("value") > 4000).cast("int").alias("value")), settled=-1, rounds=3).withColumn("value", F.col("value").cast("int"))


@query(f"""with {_GRID}, i as (select cx, cy, (value - 3000) / nullif(abs(value) + 3000, 0) as w, lead(value) over (partition by cy order by cx) as east from g) select cast(sum(cast(w > 0.1 as int)) as bigint) as water, round(avg(w), 6) as mean from i""")
def water_cells(spark, sf):
    """Cells whose water index exceeds a bound."""
    i = _grid(spark, sf).withColumn("w", (F.col("value") - 3000) / F.nullif(F.abs("value") + 3000, F.lit(0.0)))
    return i.agg(F.sum((F.col("w") > 0.1).cast("long")).alias("water"), F.round(F.avg("w"), 6).alias("mean"))


@query(f"""with {_GRID}, h as (select cast(floor(x / 12) as bigint) as cx, cast(floor(y / 12) as bigint) as cy, count(*) as shops from ({_SUPPLIERS}) group by 1, 2), z as (select cx, cy, avg(value) as near from (select a.cx, a.cy, b.value from g a join g b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1) group by 1, 2)
select g.cx, g.cy, round(value, 2) as pop, coalesce(shops, 0) as shops, cast(g.cy < 0 as int) as flooded, case when value > 5000 then 'dense' when value > 0 then 'built' else 'open' end as cover, round(near, 6) as near from g left join h using (cx, cy) left join z using (cx, cy)""")
def urban_grid(spark, sf):
    """The grid with all that is known of its cells: people, shops, flood, cover, surroundings."""
    g = _grid(spark, sf)
    shops = _points(spark, sf, "supplier", "s_suppkey").groupBy(geo.cell(F.col("x"), 12).alias("cx"), geo.cell(F.col("y"), 12).alias("cy")).agg(F.count(F.lit(1)).alias("shops"))
    near = raster.focal_sum(g).join(raster.focal_sum(g.withColumn("value", F.lit(1.0))).withColumnRenamed("focal", "n"), ["cx", "cy"])
    out = g.join(shops, ["cx", "cy"], "left").join(near, ["cx", "cy"], "left")
    cover = F.when(F.col("value") > 5000, "dense").when(F.col("value") > 0, "built").otherwise("open")
    return out.select("cx", "cy", F.round("value", 2).alias("pop"), F.coalesce("shops", F.lit(0)).alias("shops"), (F.col("cy") < 0).cast("int").alias("flooded"), cover.alias("cover"), F.round(F.col("focal") / F.col("n"), 6).alias("near"))


@query(f"with s as ({_SUPPLIERS}), c as ({_CUSTOMERS}), d as (select c.id, min(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))) filter (where s.id % 3 = 0) as hub, min(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))) filter (where s.id % 3 <> 0) as cable from c, s group by 1) select id, round(hub, 4) as hub, round(cable, 4) as cable from d")
def survey_distances(spark, sf):
    """Each survey point's distance to the nearest hub and the nearest cable landing."""
    c, s = _points(spark, sf, "customer", "c_custkey"), _points(spark, sf, "supplier", "s_suppkey")
    to = lambda df, name: spatial.nearest_join(c, df, 12.0).select(F.col("a_id").alias("id"), _r("dist").alias(name))
    return to(s.filter("id % 3 = 0"), "hub").join(to(s.filter("id % 3 <> 0"), "cable"), "id")


@query(f"with {_GRID}, n as (select distinct cx, cy, cx % 3 as patch from g where value > 8000), o as (select cx, cy from g where value > 3000 and value <= 8000), r as (select distinct patch, cx + a as cx, cy + b as cy from n, (values (-1), (0), (1)) p(a), (values (-1), (0), (1)) q(b)), k as (select * from r where (patch, cx, cy) not in (select patch, cx, cy from n)) select patch, count(*) as ring, round(100.0 * count(*) filter (where (cx, cy) in (select cx, cy from o)) / count(*), 6) as lei from k group by 1")
def expansion(spark, sf):
    """Landscape expansion: the share of old built cells in the ring about each new patch."""
    g = _grid(spark, sf)
    out = raster.expansion_index(g.filter("value > 3000 and value <= 8000"), g.filter("value > 8000").withColumn("patch", F.col("cx") % 3))
    return out.withColumn("lei", F.round("lei", 6))


def _relax(k: int) -> str:
    return f"d{k} as (select node, min(cost) as cost from (select * from d{k - 1} union all select e.v, d.cost + e.cost from d{k - 1} d join e on e.u = d.node) group by 1)"


@query(f"with {_GRID}, f as (select cx, cy, 1 + abs(value) % 7 as value from g), e as (select a.cx || ':' || a.cy as u, b.cx || ':' || b.cy as v, (a.value + b.value) / 2 * case when a.cx <> b.cx and a.cy <> b.cy then sqrt(2.0) else 1 end as cost from f a join f b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and (a.cx <> b.cx or a.cy <> b.cy)), d0 as (select min(u) as node, 0.0::double as cost from e), " + ", ".join(_relax(k) for k in range(1, 61)) + " select node, round(cost, 4) as cost from d60")
def surface_travel_cost(spark, sf):
    """Least cost of travel over a friction surface from one cell."""
    f = _grid(spark, sf).select("cx", "cy", (1 + F.abs("value") % 7).alias("value"))
    e = raster.cost_edges(f)
    start = e.agg(F.min("u").alias("o"))
    return routing.shortest_paths(e, start).select("node", _r("cost").alias("cost"))


@query("with recursive " + OD + """, f as (select o, d, w_o::double * (w_d / (1 + cost)) / sum(w_d / (1 + cost)) over (partition by o) as flow from od where o <> d) select o, d, round(flow, 4) as flow from f""")
def deterred_flows(spark, sf):
    """Each origin's production shared out by attraction and a falling function of the cost."""
    od = ng3_od(spark, sf).filter("o <> d").withColumns({"w_o": F.col("w_o").cast("double")})
    return demand.deterrence_flows(od, lambda c: 1 / (1 + c), "w_o", "w_d").withColumn("flow", _r("flow"))
