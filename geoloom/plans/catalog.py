"""Registered queries of the network, spatial and movement operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, weights
from geoloom.operators import access, graph, locate, ranks, raster, routing, spatial, temporal
from geoloom.operators.components import connected_components
from geoloom.plans.materialize import broadcast_if_small, materialize
from geoloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- shared inputs ------------------------------------------------------------------

NG3 = """flows as (select c_nationkey as u, s_nationkey as v, count(*) as n
    from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey
    where c_nationkey <> s_nationkey group by 1, 2),
  ng3 as (select u, v, n, 1000.0::double / n as cost from
    (select *, row_number() over (partition by u order by n desc, v) as k from flows) where k <= 3)"""
PATHS = (
    NG3
    + """,
  walk as (select distinct u as o, u as node, 0.0::double as cost, 0 as hops from ng3
    union all select w.o, e.v, w.cost + e.cost, w.hops + 1 from walk w join ng3 e on e.u = w.node where w.hops < 8),
  paths as (select o, node, min(cost) as cost from walk group by 1, 2)"""
)
BACK = (
    PATHS
    + """,
  best as (select p.o, p.node, arg_min(e.u, (q.cost + e.cost, e.u)) as prev from paths p join ng3 e on e.v = p.node join paths q on q.o = p.o and q.node = e.u where p.node <> p.o group by 1, 2),
  back as (select o, node as d, 0 as seq, prev as u, node as v from best
    union all select b.o, b.d, b.seq + 1, s.prev, b.u from back b join best s on s.o = b.o and s.node = b.u)"""
)
WEIGHTS = "weights as (select c_nationkey as nation, count(*) as w from customer group by 1)"


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """(u, v, n): shipments from customers' to suppliers' nations."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("u"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("v"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    joined = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.filter("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def ng3(spark: SparkSession, sf: str) -> DataFrame:
    """(u, v, n, cost): each nation's three largest flows as directed edges, written
    once, since the queries on it read it several times."""
    w = Window.partitionBy("u").orderBy(F.desc("n"), "v")
    top = flows(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return materialize(top.select("u", "v", "n", (1000.0 / F.col("n")).alias("cost")).coalesce(1), "ng3")


def nation_weights(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("w"))


def ng3_od(spark: SparkSession, sf: str) -> DataFrame:
    """(o, d, cost, w_o, w_d) of the reachable pairs of NG3, o itself included."""
    edges = ng3(spark, sf)
    found = routing.shortest_paths(edges, edges.select(F.col("u").alias("o"))).select("o", F.col("node").alias("d"), "cost")
    w = nation_weights(spark, sf)
    w = broadcast_if_small(materialize(w, "weights"), 100_000)
    at = lambda end: w.select(F.col("nation").alias(end), F.col("w").alias(f"w_{end}"))
    return found.join(at("o"), "o").join(at("d"), "d")


OD = PATHS + ", " + WEIGHTS + ", od as (select o, node as d, cost, a.w as w_o, b.w as w_d from paths join weights a on a.nation = o join weights b on b.nation = node)"


# --- filters, projections, recodes ---------------------------------------------------


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_shipdate < timestamp '1996-01-01' and l_quantity < 10")
def scan_filter_roads(spark, sf):
    df = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") < "1996-01-01") & (F.col("l_quantity") < 10))
    return df.select("l_orderkey", "l_linenumber", "l_returnflag")


@query("""select p_partkey, round(p_size * 100.0 / 1000 / case p_type when 'BRASS' then 40 when 'STEEL' then 50 when 'COPPER' then 30 else 20 end * 3600, 4) as seconds from part""")
def travel_time(spark, sf):
    speed = weights.lookup(F.col("p_type"), {"BRASS": 40, "STEEL": 50, "COPPER": 30}, 20)
    return table(spark, sf, "part").select("p_partkey", _r(weights.travel_seconds(F.col("p_size") * 100.0, speed)).alias("seconds"))


@query("""select p_partkey, case when p_size > 0 then round(p_size * 10.0 / 1000 * 3600 / greatest(4.5 * exp(-3.5 * abs((p_partkey % 21 - 10) / 20.0 + 0.05)), 0.1), 4) end as seconds from part""")
def walk_time_tobler(spark, sf):
    slope = (F.col("p_partkey") % 21 - 10) / 20.0
    return table(spark, sf, "part").select("p_partkey", _r(weights.walk_seconds(F.col("p_size") * 10.0, slope)).alias("seconds"))


@query("""select p_partkey, round(p_retailprice * (1 + 0.1 * coalesce(nullif(p_size, 1), m)), 4) as cost from part, (select avg(nullif(p_size, 1)) as m from part)""")
def road_cost_iri(spark, sf):
    p = table(spark, sf, "part").withColumn("iri", F.nullif("p_size", F.lit(1)))
    mean = F.broadcast(p.agg(F.avg("iri").alias("m")))
    return p.crossJoin(mean).select("p_partkey", _r(weights.road_cost(F.col("p_retailprice"), F.col("iri"), F.col("m"), 1.0, 0.1)).alias("cost"))


@query("""with s as (select s_nationkey, sum(case when s_acctbal < 2000 then 1 else 0 end) / count(*)::double as x from supplier group by 1)
select s_nationkey, round(x, 4) as rural_share, case when x > 0.5 then 'Rural' when x > 0.2 and x < 0.5 then 'Intermediate' when x < 0.2 then 'Urban' end as class from s""")
def urban_classes(spark, sf):
    share = F.sum(F.when(F.col("s_acctbal") < 2000, 1).otherwise(0)) / F.count(F.lit(1))
    df = table(spark, sf, "supplier").groupBy("s_nationkey").agg(share.alias("x"))
    return df.select("s_nationkey", _r("x").alias("rural_share"), weights.urban_class(F.col("x")).alias("class"))


@query("""select o_orderkey, case when o_totalprice > 0 and o_totalprice <= 50000 then 0 when o_totalprice > 50000 and o_totalprice <= 100000 then 1 when o_totalprice > 100000 and o_totalprice <= 200000 then 2 end as bin from orders""")
def time_bins_cut(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", weights.right_closed_bin(F.col("o_totalprice"), [0, 50_000, 100_000, 200_000]).alias("bin"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, upper(event_type[1]) || event_type[2:] as title, split_part(event_type, 'i', 1) as head, hour(ts) * 60 + minute(ts) as minute_of_day from events""")
def scalar_functions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        "event_id", k.alias("k"), F.initcap("event_type").alias("title"), F.split_part("event_type", F.lit("i"), F.lit(1)).alias("head"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("minute_of_day")
    )


@query("""select c_custkey, cast(32700 - round((45 + lat) / 90) * 100 + round((183 + lon) / 6) as int) as epsg, round(radians(lon) * 6378137.0, 3) as mx, round(case when abs(lat) < 89 then ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 end, 3) as my
from (select c_custkey, ((c_custkey * 37) % 360 - 180)::double as lon, ((c_custkey * 17) % 180 - 90)::double as lat from customer)""")
def project_points(spark, sf):
    lon, lat = geo.synthetic_lon(F.col("c_custkey")), geo.synthetic_lat(F.col("c_custkey"))
    df = table(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return df.select("c_custkey", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round(x, 3).alias("mx"), F.when(F.abs("lat") < 89, F.round(y, 3)).alias("my"))


# --- joins -----------------------------------------------------------------------------


@query("select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_nodes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_semi")


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_nodes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_anti")


@query("with " + NG3 + """ select coalesce(a.u, b.v) as u, coalesce(a.v, b.u) as v, coalesce(a.n, 0) as outflow, coalesce(b.n, 0) as inflow, coalesce(a.n, 0) - coalesce(b.n, 0) as net
from ng3 a full join ng3 b on a.u = b.v and a.v = b.u""")
def full_outer_net_flow(spark, sf):
    e = ng3(spark, sf)
    a, b = e.select("u", "v", F.col("n").alias("outflow")), e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("inflow"))
    out = a.join(b, ["u", "v"], "full").fillna(0, ["outflow", "inflow"])
    return out.withColumn("net", F.col("outflow") - F.col("inflow"))


@query("""select p.event_id, v.value as view_value from (select * from events where event_type = 'purchase') p
asof left join (select user_id, ts, value from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_nearest_lower(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return spatial.as_of_join(left, right, ["user_id"], "ts", "view_value").select("event_id", "view_value")


@query("""with n as (select n_nationkey as k, ((n_nationkey * 37) % 360 - 180)::double as lon, ((n_nationkey * 17) % 180 - 90)::double as lat from nation)
select a.k as o, b.k as d, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 4) as km from n a, n b""")
def cross_centroid_distance(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), geo.synthetic_lon(F.col("n_nationkey")).alias("lon"), geo.synthetic_lat(F.col("n_nationkey")).alias("lat"))
    a, b = n.toDF("o", "alon", "alat"), F.broadcast(n.toDF("d", "blon", "blat"))
    return a.crossJoin(b).select("o", "d", _r(geo.haversine_km(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))).alias("km"))


_SUPPLIERS = "select s_suppkey as id, ((s_suppkey * 37) % 360 - 180)::double as x, ((s_suppkey * 17) % 180 - 90)::double as y from supplier"
_CUSTOMERS = "select c_custkey as id, ((c_custkey * 37) % 360 - 180)::double as x, ((c_custkey * 17) % 180 - 90)::double as y from customer"


def _points(spark, sf, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), geo.synthetic_lon(k).alias("x"), geo.synthetic_lat(k).alias("y"))


@query(f"with s as ({_SUPPLIERS}) select a.id as a_id, b.id as b_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) as dist from s a, s b where a.id <> b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 12.5")
def range_join_within(spark, sf):
    s = _points(spark, sf, "supplier", "s_suppkey")
    return spatial.within_distance(s, s, 12.5).filter("a_id <> b_id").select("a_id", "b_id", _r("dist").alias("dist"))


@query(f"""with s as ({_SUPPLIERS}), c as ({_CUSTOMERS}), d as (select c.id as a_id, s.id as b_id, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) as dist from c, s)
select a_id, b_id, round(dist, 4) as dist, rank from (select *, cast(row_number() over (partition by a_id order by dist, b_id) as int) as rank from d) where rank <= 2""")
def knn_snap(spark, sf):
    found = spatial.nearest_join(_points(spark, sf, "customer", "c_custkey"), _points(spark, sf, "supplier", "s_suppkey"), 8.0, 2)
    return found.select("a_id", "b_id", _r("dist").alias("dist"), "rank")


_RINGS = {1: [(-100, -50), (-20, -60), (10, 20), (-60, 45), (-120, 10), (-100, -50)], 2: [(0, 0), (90, 5), (120, 60), (40, 80), (0, 0)], 3: [(-170, -80), (-130, -80), (-130, -30), (-170, -30), (-170, -80)]}
_EDGES = ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, r in _RINGS.items() for a, b in zip(r, r[1:], strict=False))


@query(f"""with c as ({_CUSTOMERS}), e(poly_id, x1, y1, x2, y2) as (values {_EDGES})
select id, cast(poly_id as int) as poly_id from c, e group by id, poly_id
having sum(case when ((y1 > y) <> (y2 > y)) and x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0)::double + x1 then 1 else 0 end) % 2 = 1""")
def ray_cast_polygon(spark, sf):
    rings = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in _RINGS.items()], "poly_id int, ring array<struct<x:double,y:double>>")
    return spatial.points_in_polygons(_points(spark, sf, "customer", "c_custkey"), rings, 30.0).select("id", "poly_id")


@query(f"with c as ({_CUSTOMERS}) select cast(floor(x / 5) as bigint) as cx, cast(floor(y / 5) as bigint) as cy, count(*) as n from c group by 1, 2")
def point_in_cell(spark, sf):
    return _points(spark, sf, "customer", "c_custkey").groupBy(geo.cell(F.col("x"), 5).alias("cx"), geo.cell(F.col("y"), 5).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query("""select n_name, r_name as best, d from (select n_name, r_name, levenshtein(n_name, r_name) as d, row_number() over (partition by n_name order by levenshtein(n_name, r_name), r_name) as k from nation, region) where k = 1 and d <= 50""")
def fuzzy_join(spark, sf):
    n, r = table(spark, sf, "nation").select("n_name"), F.broadcast(table(spark, sf, "region").select("r_name"))
    best = n.crossJoin(r).groupBy("n_name").agg(F.min(F.struct(F.levenshtein("n_name", "r_name").cast("long").alias("d"), "r_name")).alias("x"))
    return best.filter("x.d <= 50").select("n_name", F.col("x.r_name").alias("best"), "x.d")


@query("""select q_id, e_id, rank from (select q.vec_id as q_id, e.vec_id as e_id, cast(row_number() over (partition by q.vec_id order by round(list_distance(q.embedding::double[], e.embedding::double[]), 6), e.vec_id) as int) as rank
from embeddings q, embeddings e where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id) where rank <= 3""")
def embedding_knn(spark, sf):
    """The three nearest vectors (Euclidean) of each query vector (ids divisible by 50), against all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return spatial.nearest_vectors(e.filter("id % 50 = 0"), e, 3)


# --- aggregates -------------------------------------------------------------------------


@query("select c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 4) as mean_bal, count(*) as n, round(min(c_acctbal), 2) as low, round(max(c_acctbal), 2) as high from customer group by 1")
def weighted_mean_group(spark, sf):
    c = F.col
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        _r(F.sum(c("c_acctbal") * c("c_custkey")) / F.sum("c_custkey")).alias("mean_bal"), F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high")
    )


@query("""select o_orderpriority, cast(count(*) filter (where o_totalprice < 50000) as bigint) as under_50k, cast(count(*) filter (where o_totalprice < 100000) as bigint) as under_100k, cast(count(*) filter (where o_totalprice < 200000) as bigint) as under_200k from orders group by 1""")
def threshold_buckets(spark, sf):
    n = lambda cut: F.sum(F.when(F.col("o_totalprice") < cut, 1).otherwise(0))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(*(n(k * 1000).alias(f"under_{k}k") for k in (50, 100, 200)))


@query("""select year(l_shipdate) as year, round(avg(case when l_returnflag = 'A' then 1.0 else 0 end), 6) as share_a, round(avg(case when l_returnflag = 'N' then 1.0 else 0 end), 6) as share_n, round(avg(case when l_returnflag = 'R' then 1.0 else 0 end), 6) as share_r from lineitem group by 1""")
def pivot_shares(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
    total = F.col("A") + F.col("N") + F.col("R")
    return df.select("year", *(F.round(F.col(k) / total, 6).alias(f"share_{k.lower()}") for k in "ANR"))


@query("""select l_returnflag, l_linestatus, year(l_shipdate) as year, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by grouping sets ((l_returnflag), (l_linestatus, year(l_shipdate)), (l_returnflag, l_linestatus), ())""")
def grouping_sets(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    f, s, y = F.col("l_returnflag"), F.col("l_linestatus"), F.col("year")
    return df.groupingSets([[f], [s, y], [f, s], []], f, s, y).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""select r_name, n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def rollup_admin(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    df = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""select o_orderpriority, round(median(o_totalprice), 4) as med, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.9), 4) as p90, round(stddev_pop(o_totalprice), 2) as sd from orders group by 1""")
def median_pctl(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    p = ranks.percentiles(o, ["o_orderpriority"], "o_totalprice", {"med": 0.5, "p25": 0.25, "p90": 0.9})
    sd = o.groupBy("o_orderpriority").agg(F.round(F.stddev_pop("o_totalprice"), 2).alias("sd"))
    return p.join(sd, "o_orderpriority").select("o_orderpriority", *(_r(c).alias(c) for c in ("med", "p25", "p90")), "sd")


@query("select p_type, p_brand, count(*) as n from part group by 1, 2")
def cross_tab(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("select c_nationkey, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments, count(distinct c_mktsegment) as n from customer group by 1")
def collect_names(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.count_distinct("c_mktsegment").alias("n"))


@query("""with h as (select cast(floor(s_acctbal / 500) as bigint) as bin, count(*) as n from supplier group by 1) select bin, n, cast(sum(n) over (order by bin) as bigint) as upto, cast(sum(n) over (order by bin desc) as bigint) as from_here from h""")
def histogram_cumulative(spark, sf):
    h = table(spark, sf, "supplier").groupBy(F.floor(F.col("s_acctbal") / 500).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumns({"upto": F.sum("n").over(Window.orderBy("bin")), "from_here": F.sum("n").over(Window.orderBy(F.desc("bin")))})


@query("select round(sum(x) / sum(a), 6) as discontiguity from (select p_size as a, sum(p_size) over (order by p_size range unbounded preceding) - p_size as x from part)")
def discontiguity(spark, sf):
    """Sum over patches of the areas of the other patches no larger, over the total: counted by size first, so the window holds one row a size."""
    by = table(spark, sf, "part").groupBy(F.col("p_size").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    df = by.withColumn("upto", F.sum(F.col("a") * F.col("n")).over(Window.orderBy("a")))
    return df.agg(F.round(F.sum(F.col("n") * (F.col("upto") - F.col("a"))) / F.sum(F.col("a") * F.col("n")), 6).alias("discontiguity"))


# --- windows ------------------------------------------------------------------------------


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders")
def transform_share(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 6).alias("share"))


@query("select c_custkey, round((c_acctbal - lo) / nullif(hi - lo, 0), 6) as score from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)")
def minmax_norm(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ends = F.broadcast(c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")))
    return c.crossJoin(ends).select("c_custkey", F.round((F.col("c_acctbal") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("score"))


@query("""select event_id, round(value - lag(value) over w, 4) as step, coalesce(lead(value) over w, 0) as next, coalesce(lag(value) over w, value) as prior from events window w as (partition by user_id order by ts, event_id)""")
def diff_lead_lag(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", _r(v - F.lag("value").over(w)).alias("step"), F.coalesce(F.lead("value").over(w), F.lit(0.0)).alias("next"), F.coalesce(F.lag("value").over(w), v).alias("prior"))


@query("""select event_id, cast(sum(coalesce(g, 0)) over (partition by user_id order by ts, event_id) as bigint) as session from
(select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 21600 * 1000000::bigint then 1 else 0 end as g from events)""")
def sessions_gap(spark, sf):
    return temporal.sessions(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 21_600, "event_id").select("event_id", "session")


@query("""select user_id, min(day) as first_day, max(day) as last_day, count(*) as days from
(select *, day - cast(row_number() over (partition by user_id order by day) as int) as run from (select distinct user_id, ts::date as day from events)) group by user_id, run""")
def islands(spark, sf):
    return temporal.islands(table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""select event_id, case when count(value) over w = 5 then round(sum(value) over w, 4) end as rolling from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""")
def rolling5(spark, sf):
    df = temporal.rolling_sum(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 5)
    return df.select("event_id", _r("rolling").alias("rolling"))


@query("""with m as (select date_trunc('month', o_orderdate)::date as month, sum(o_totalprice) as total from orders group by 1) select month, round(total, 2) as total, round(sum(total) over (order by month), 2) as running from m""")
def running_total(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return m.select("month", F.round("total", 2).alias("total"), F.round(F.sum("total").over(Window.orderBy("month")), 2).alias("running"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as nth from orders")
def cumcount(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("nth"))


@query("select p_partkey, dense_rank() over (order by p_type, p_brand) - 1 as grp from part")
def ngroup(spark, sf):
    """Group numbers in the order of the keys: ranked over the distinct keys, then joined, so the global window never holds the rows."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    keys = ranks.running(p.select("p_type", "p_brand").distinct(), [], ["p_type", "p_brand"]).select("p_type", "p_brand", F.col("rank").alias("grp"))
    return p.join(keys, ["p_type", "p_brand"]).select("p_partkey", "grp")


@query("""select user_id, ts::date as day, count(*) as n, round(min(value), 4) as low, round(max(value), 4) as high, round(sum(value), 4) as total from events group by 1, 2""")
def daily_rollup(spark, sf):
    df = temporal.daily(table(spark, sf, "events"), "user_id", "ts", "value")
    return df.select("user_id", "day", "n", *(_r(c).alias(c) for c in ("low", "high", "total")))


@query("""select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def event_5min(spark, sf):
    from geoloom.streaming.events import counts_by_window

    return counts_by_window(table(spark, sf, "events")).withColumn("total", _r("total"))


# --- sorts, sets, shapes --------------------------------------------------------------------


@query("""with a as (select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 50), b as (select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from a) order by c_custkey desc limit 50)
select c_custkey, 'balance' as pick from a union all select c_custkey, 'key' from b""")
def topk_union(spark, sf):
    """The 50 largest balances (the feature is a top-k list), then the 50 largest keys of the rest."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    a = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    b = c.join(F.broadcast(a.select("c_custkey")), "c_custkey", "left_anti").orderBy(F.desc("c_custkey")).limit(50)
    return a.select("c_custkey", F.lit("balance").alias("pick")).unionByName(b.select("c_custkey", F.lit("key").alias("pick")))


@query("""select s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) as s_suppkey, round(min(s_acctbal), 2) as low from supplier group by 1""")
def argmin_nearest(spark, sf):
    best = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min(F.struct("s_acctbal", "s_suppkey")).alias("x"))
    return best.select("s_nationkey", "x.s_suppkey", F.round("x.s_acctbal", 2).alias("low"))


@query("""select l_orderkey, l_linenumber, measure, amount from (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) unpivot (amount for measure in (l_quantity, l_discount, l_tax))""")
def melt_unpivot(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return df.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("select c_custkey as k from customer except select o_custkey from orders")
def except_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("""select o_orderkey from (select o_orderkey, sum(o_totalprice) over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) - o_totalprice as spent from orders) where spent < 2000000""")
def budget_prefix(spark, sf):
    df = ranks.running(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], "o_totalprice")
    return df.filter(F.col("running") - F.col("o_totalprice") < 2_000_000).select("o_orderkey")


# --- graphs -----------------------------------------------------------------------------------


@query("with " + NG3 + " select u, v, n, round(cost, 6) as cost from ng3")
def edge_list(spark, sf):
    return ng3(spark, sf).withColumn("cost", F.round("cost", 6))


@query("with " + NG3 + " select u, v, round(cost, 6) as cost from ng3 union all select v, u, round(cost, 6) from ng3 a where not exists (select 1 from ng3 b where b.u = a.v and b.v = a.u)")
def reflect_edges(spark, sf):
    return graph.reflect_missing(ng3(spark, sf).select("u", "v", F.round("cost", 6).alias("cost")))


@query("""select u, v, l_orderkey, l_linenumber from (select l_suppkey % 50 as u, l_partkey % 50 as v, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey % 50, l_partkey % 50 order by l_quantity desc, l_orderkey, l_linenumber) as k from lineitem) where k = 1""")
def dedupe_edges(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("u"), (F.col("l_partkey") % 50).alias("v"), F.col("l_quantity").alias("length"), "l_orderkey", "l_linenumber")
    return graph.simple_graph(e, "longest", "length", ["l_orderkey", "l_linenumber"]).drop("length")


@query("""with recursive e as (select l_suppkey as u, l_suppkey + 10 * (1 + l_partkey % 2) as v from lineitem),
b as (select distinct u, v from (select u, v from e union all select v, u from e)),
r(node, seen) as (select u, u from b union select b.v, r.seen from r join b on b.u = r.node)
select node, min(seen) as component from r group by node""")
def component_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    return connected_components(li.select(F.col("l_suppkey").alias("u"), (F.col("l_suppkey") + 10 * (1 + F.col("l_partkey") % 2)).alias("v")))


@query("with " + NG3 + ", bad as (select s_nationkey as node from supplier group by 1 having avg(s_acctbal) > 5000) select u, v, round(case when u in (select node from bad) or v in (select node from bad) then 99999999 else cost end, 6) as cost from ng3")
def disrupt_by_node(spark, sf):
    risk = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.avg("s_acctbal").alias("risk"))
    return graph.disrupt_nodes(ng3(spark, sf).select("u", "v", "cost"), risk, "risk", 5000, 99_999_999).select("u", "v", F.round("cost", 6).alias("cost"))


@query("with " + NG3 + ", " + WEIGHTS + " select u, v, round(cost + coalesce(a.w, 0) / 2.0 + coalesce(b.w, 0) / 2.0, 6) as cost from ng3 left join weights a on a.nation = u left join weights b on b.nation = v")
def node_cost_edges(spark, sf):
    w = nation_weights(spark, sf).select(F.col("nation").alias("node"), F.col("w").alias("cost"))
    return graph.node_costs_to_edges(ng3(spark, sf).select("u", "v", "cost"), w).select("u", "v", F.round("cost", 6).alias("cost"))


@query("""select l_orderkey, l_linenumber, cast(piece as int) as piece, piece * 8.0::double as from_len, least((piece + 1) * 8.0::double, l_quantity) as to_len from lineitem, unnest(generate_series(0, greatest(ceil(l_quantity / 8.0)::bigint, 1) - 1)) as t(piece)""")
def salt_edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return graph.salt_long(li, 8.0, "l_quantity").drop("l_quantity")


@query("with " + NG3 + ", x as (select u as node, v as other from ng3 union all select v, u from ng3) select node, count(*) as degree, count(distinct other) as near from x group by 1")
def node_degree(spark, sf):
    e = ng3(spark, sf)
    x = e.select(F.col("u").alias("node"), F.col("v").alias("other")).union(e.select("v", "u"))
    return x.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("near"))


# --- routing and access --------------------------------------------------------------------------


@query("with recursive " + PATHS + " select a.o, b.d, coalesce(round(cost, 6), 99999999) as cost from (select distinct u as o from ng3) a cross join (select distinct u as d from ng3) b left join paths p on p.o = a.o and p.node = b.d")
def od_matrix(spark, sf):
    e = ng3(spark, sf)
    out = routing.od_matrix(e, e.select(F.col("u").alias("o")), e.select(F.col("u").alias("d")), fail_value=99_999_999)
    return out.withColumn("cost", F.round("cost", 6))


@query("with recursive " + PATHS + " select o, threshold, count(*) as nodes, round(max(cost), 6) as farthest from paths, (values (5.0::double), (20.0), (80.0)) t(threshold) where cost <= threshold group by 1, 2")
def isochrone(spark, sf):
    e = ng3(spark, sf)
    iso = routing.isochrone(routing.shortest_paths(e, e.select(F.col("u").alias("o"))), [5, 20, 80])
    return iso.withColumn("farthest", F.round("farthest", 6))


_DECAYS = ", ".join(f"({x!r}::double)" for x in access.DECAYS)


@query("with recursive " + OD + f" select o, decay, round(sum(w_o * w_d * exp(-decay * cost)), 4) as access from od, (values {_DECAYS}) t(decay) group by 1, 2")
def gravity_access(spark, sf):
    return access.gravity(ng3_od(spark, sf)).withColumn("access", _r("access"))


@query("with recursive " + OD + " select o, round(coalesce(sum(case when cost <= 60 and cost > 0 then w_d / cost end), 0), 4) as access from od group by 1")
def market_access_ratio(spark, sf):
    return access.market_access(ng3_od(spark, sf), 60.0).withColumn("access", _r("access"))


@query("with recursive " + OD + """, m as (select max(cost) as m from od), r as (select o, d, case when o = d then 0.0 else w_o * w_d * exp(-1.0 * cost / m.m) end as raw from od, m)
select o, d, cast(ceil(round(raw / (select max(raw) from r) * 100, 9)) as bigint) as trips from r""")
def gravity_demand_ceil(spark, sf):
    return access.gravity_demand(ng3_od(spark, sf))


@query("with recursive " + OD + """, n as (select *, count(*) over (partition by o) as k from od where cost > 0 and cost < 60)
select d, cast(sum(w_o) as bigint) as total, cast(coalesce(sum(case when k = 1 then w_o end), 0) as bigint) as only, round(coalesce(sum(case when k = 1 then w_o end), 0) / sum(w_o), 6) as share from n group by 1""")
def catchment_unique(spark, sf):
    return access.catchment(ng3_od(spark, sf), 60.0).withColumn("share", F.round("share", 6))


@query("with recursive " + OD + """, b as (select o, w_o, arg_min(d, (cost, d)) as d, min(cost) as cost from od where d in (select s_nationkey from supplier where s_acctbal > 5000) group by 1, 2) select d, cast(sum(w_o) as bigint) as pop, count(*) as origins from b group by 1""")
def catchment_pop(spark, sf):
    """Population served by each facility: the nations with a supplier of means hold one."""
    od = ng3_od(spark, sf)
    sites = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("d")).distinct()
    near = access.nearest(od.join(sites, "d", "left_semi").select("o", "d", "cost"))
    return near.join(od.select("o", "w_o").distinct(), "o").groupBy("d").agg(F.sum("w_o").alias("pop"), F.count(F.lit(1)).alias("origins"))


_ROUNDS = ", ".join(
    f"r{k} as (select o, d, p, a, case when sum(flow) over (partition by o) > 0 then flow * p / sum(flow) over (partition by o) else 0 end as flow from c{k - 1}), "
    f"c{k} as (select o, d, p, a, case when sum(flow) over (partition by d) > 0 then flow * a / sum(flow) over (partition by d) else 0 end as flow from r{k})"
    for k in range(1, 11)
)


@query("with recursive " + OD + f", c0 as (select o, d, w_o::double as p, w_d::double as a, 10000 / cost as flow from od where o <> d), {_ROUNDS} select o, d, round(case when flow < 0.1 then 0 else flow end, 4) as flow from c10")
def furness10(spark, sf):
    od = ng3_od(spark, sf).filter("o <> d")
    cells = od.select("o", "d", (10_000 / F.col("cost")).alias("weight"), F.col("w_o").cast("double").alias("production"), F.col("w_d").cast("double").alias("attraction"))
    return access.furness(cells).withColumn("flow", _r("flow"))


@query("with recursive " + BACK + " select u, v, cast(count(*) as double) as flow from back group by 1, 2")
def aon_assignment(spark, sf):
    e = ng3(spark, sf)
    paths = routing.shortest_paths(e, e.select(F.col("u").alias("o")))
    demand = paths.filter("hops > 0").select("o", F.col("node").alias("d"), F.lit(1.0).alias("flow"))
    return routing.assign_flows(paths, demand)


_BROKEN = ", ".join(
    f"b{k} as (select bu, bv, o, node, min(cost) as cost from (select * from b{k - 1} union all select x.bu, x.bv, x.o, e.v, x.cost + e.cost from b{k - 1} x join ng3 e on e.u = x.node where not (e.u = bu and e.v = bv)) group by 1, 2, 3, 4)"
    for k in range(1, 17)
)


@query("with recursive " + BACK + f""", b0 as (select distinct u as bu, v as bv, o, o as node, 0.0::double as cost from back), {_BROKEN},
t as (select k.u, k.v, k.o, k.d, p.cost as base, b.cost from back k join paths p on p.o = k.o and p.node = k.d left join b16 b on b.bu = k.u and b.bv = k.v and b.o = k.o and b.node = k.d where k.d in (select u from ng3))
select u as edge_u, v as edge_v, round(coalesce(sum(cost - base), 0), 4) as extra, cast(sum(case when cost is null then 1 else 0 end) as bigint) as lost, count(*) as pairs from t group by 1, 2""")
def edge_criticality(spark, sf):
    """Extra cost and lost pairs for each edge when it breaks."""
    e = ng3(spark, sf).select("u", "v", "cost")
    ends = e.select(F.col("u").alias("o"))
    broken = routing.break_edges(e, e, ends, ends.withColumnRenamed("o", "d"))
    lost = F.sum(F.when(F.col("cost").isNull(), 1).otherwise(0))
    return broken.groupBy("edge_u", "edge_v").agg(_r(F.coalesce(F.sum(F.col("cost") - F.col("base")), F.lit(0.0))).alias("extra"), lost.alias("lost"), F.count(F.lit(1)).alias("pairs"))


@query("with recursive " + BACK + " select o, d, seq, u, v from back")
def route_listing(spark, sf):
    e = ng3(spark, sf)
    paths = routing.shortest_paths(e, e.select(F.col("u").alias("o")))
    return routing.path_edges(paths, paths.filter("hops > 0").select("o", F.col("node").alias("d")))


# --- cells and sites --------------------------------------------------------------------------------

def _grid(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(geo.cell(geo.synthetic_lon(k), 12).alias("cx"), geo.cell(geo.synthetic_lat(k), 12).alias("cy"), F.col("c_acctbal").alias("value"))
    return df.groupBy("cx", "cy").agg(F.sum("value").alias("value"))


_GRID = f"c as ({_CUSTOMERS}), g as (select cast(floor(x / 12) as bigint) as cx, cast(floor(y / 12) as bigint) as cy, sum(c_acctbal) as value from c join customer on c_custkey = id group by 1, 2)"


@query(f"with {_GRID}, z as (select distinct cx, cy, cx % 4 + 10 as zone from g union all select 999, 999, 77) select zone, count(value) as n, round(coalesce(sum(value), -1), 2) as total, round(coalesce(min(value), -1), 2) as low, round(coalesce(max(value), -1), 2) as high, round(coalesce(avg(value), -1), 2) as mean from z left join g using (cx, cy) group by 1")
def zonal_stats(spark, sf):
    g = _grid(spark, sf)
    zones = g.select("cx", "cy", (F.col("cx") % 4 + 10).alias("zone")).union(spark.createDataFrame([(999, 999, 77)], "cx long, cy long, zone long"))
    return raster.zonal_stats(g, zones).select("zone", "n", *(F.round(c, 2).alias(c) for c in ("total", "low", "high", "mean")))


@query(f"with {_GRID} select a.cx, a.cy, round(sum(b.value), 2) as focal from g a join g b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 group by 1, 2")
def focal_sum(spark, sf):
    return raster.focal_sum(_grid(spark, sf)).withColumn("focal", F.round("focal", 2))


@query(f"""with recursive {_GRID}, h as (select * from g where value > (select avg(value) from g)), m as (select cx, cy, value, (cx + 1000) * 100000 + cy + 1000 as k from h),
r(k, seen) as (select k, k from m union select b.k, r.seen from r join m a on a.k = r.k join m b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1),
l as (select k, min(seen) as root from r group by 1) select m.cx, m.cy, round(sum(m.value) over (partition by root), 2) as total from m join l using (k)""")
def urban_clusters(spark, sf):
    g = _grid(spark, sf)
    mean = g.agg(F.avg("value")).first()[0] or 0.0
    return raster.clusters(g, mean, float("-inf")).select("cx", "cy", F.round("total", 2).alias("total"))


@query("""with f as (select case when p_size > 20 then 1 else 0 end as a, case when p_retailprice > 1400 then 1 else 0 end as b from part) select round(case when sum(greatest(a, b)) > 0 then sum(a * b) / sum(greatest(a, b)) else -1 end, 6) as jaccard from f""")
def jaccard(spark, sf):
    return raster.jaccard(_flags(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query("""with f as (select case when p_size > 20 then 1 else 0 end as a, case when p_retailprice > 1400 then 1 else 0 end as b from part), s as (select avg(case when a = b then 1.0 else 0 end) as p, avg(a) as a, avg(b) as b, count(*) as n from f)
select round((p - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) as kappa, n from s""")
def kappa(spark, sf):
    return raster.kappa(_flags(spark, sf)).withColumn("kappa", F.round("kappa", 6))


def _flags(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_size") > 20).cast("int").alias("a"), (F.col("p_retailprice") > 1400).cast("int").alias("b"))


@query("with recursive " + OD + """, s as (select distinct d from od), k as (select a.d as a, b.d as b, c.d as c from s a, s b, s c where a.d < b.d and b.d < c.d),
m as (select a, b, c, o, min(cost * w_o) as x from k, od where d in (a, b, c) group by all),
t as (select a, b, c, count(*) as n, sum(x) as x from m group by all order by n desc, round(sum(x), 9), a, b, c limit 1) select unnest([a, b, c]) as d from t""")
def p_median_sites(spark, sf):
    od = ng3_od(spark, sf).select("o", "d", F.col("cost"), F.col("w_o").cast("double").alias("w_o"))
    return locate.p_median(od, 3)


_COVER0 = "l0 as (select distinct o, d, w_o::double as w from od where cost <= 60)"


def _picks(rounds: int, go_on: str) -> str:
    """Greedy picks as CTEs: k<i> the choice of round i, l<i + 1> what it leaves open."""
    return ", ".join(
        f"k{i} as (select {i} as pick, d, sum(w) as gained from l{i} {go_on.format(i=i)} group by d order by gained desc, d limit 1), l{i + 1} as (select * from l{i} where o not in (select o from l{i} where d in (select d from k{i})))"
        for i in range(rounds)
    )


_GOT = ["0"] + [" + ".join(f"coalesce((select gained from k{j}), 0)" for j in range(i)) for i in range(1, 26)]


@query("with recursive " + OD + f", {_COVER0}, " + _picks(3, "where w > 0") + " select * from (" + " union all ".join(f"select * from k{i}" for i in range(3)) + ") t")
def max_cover_sites(spark, sf):
    od = ng3_od(spark, sf).select("o", "d", "cost", F.col("w_o").cast("double").alias("w_o"))
    return locate.max_cover(od, 3, 60.0)


@query("with recursive " + OD + f", {_COVER0}, t as (select sum(w) as total from (select distinct o, w from l0)), "
       + _picks(25, "where {{got{i}}} < 0.9 * (select total from t) - 1e-9").format(**{f"got{i}": _GOT[i] for i in range(25)})
       + " select * from (" + " union all ".join(f"select * from k{i}" for i in range(25)) + ") t")
def set_cover_sites(spark, sf):
    od = ng3_od(spark, sf).select("o", "d", "cost", F.col("w_o").cast("double").alias("w_o"))
    return locate.set_cover(od, 60.0, 0.9)


def _accepted(rounds: int) -> str:
    """Rounds of deferred acceptance as CTEs: a<i> what is still asked for before round i, j<i> what is kept or turned down in it."""
    return ", ".join(
        f"j{i} as materialized (select a.*, sum(w) over (partition by d order by cost, o rows unbounded preceding) as load from (select * from a{i} qualify row_number() over (partition by o order by cost, d) = 1) a), a{i + 1} as materialized (select * from a{i} where (o, d) not in (select (o, d) from j{i} where load > (select cap from room)))"
        for i in range(rounds)
    )


@query("with recursive " + OD + """, site as (select nation as d from weights where w > (select avg(w) from weights)), a0 as materialized (select o, d, cost, w_o::double as w from od join site using (d)),
room as (select 1.1 * sum(w) / (select count(distinct d) from a0) as cap from (select distinct o, w from a0)), """ + _accepted(60) + " select o, d, round(cost, 6) as cost from j59 where load <= (select cap from room)")
def capacitated_sites(spark, sf):
    """Origins dealt to the nations of more than average weight, each with room for a tenth more than an even share."""
    od = materialize(ng3_od(spark, sf).select("o", "d", "cost", F.col("w_o").cast("double").alias("w_o")), "od")
    w = nation_weights(spark, sf)
    sites = w.join(F.broadcast(w.agg(F.avg("w").alias("mean"))), F.col("w") > F.col("mean")).select(F.col("nation").alias("d")).join(od.select("d").distinct(), "d", "left_semi")
    weight = od.join(sites, "d", "left_semi").select("o", "w_o").distinct().agg(F.sum("w_o").alias("all"))
    room = weight.join(sites.agg(F.count(F.lit(1)).alias("n"))).select((1.1 * F.col("all") / F.col("n")).alias("cap"))
    return locate.capacitated(od, sites, sites.join(F.broadcast(room))).withColumn("cost", F.round("cost", 6))
