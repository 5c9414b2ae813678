"""Further registered queries: movement, urban form, comparison and summary measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import graph, ranks, spatial, temporal
from geoloom.plans.catalog import _CUSTOMERS, _GRID, _SUPPLIERS, NG3, OD, _grid, _points, _r, ng3, ng3_od, query
from geoloom.plans.materialize import broadcast_if_small, materialize
from geoloom.sources.tables import table


@query("""select user_id, case when n >= 60 and spread > 100 then 'Migration' when spread > 100 then 'LongTrip' when n >= 60 then 'LocalCommute' when n < 3 then 'Other' else 'LocalTrip' end as class
from (select user_id, count(*) as n, max(value) - min(value) as spread from events group by 1)""")
def classify_users(spark, sf):
    df = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    many, wide = F.col("n") >= 60, F.col("spread") > 100
    return df.select("user_id", F.when(many & wide, "Migration").when(wide, "LongTrip").when(many, "LocalCommute").when(F.col("n") < 3, "Other").otherwise("LocalTrip").alias("class"))


@query("select event_id from (select event_id, count(*) over (partition by user_id) as n from events) where n >= 60")
def drop_sparse_groups(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    enough = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60").select("user_id")
    return e.join(enough, "user_id", "left_semi").select("event_id")


@query("""select user_id, session, count(*) as n, round(sum(value), 4) as total, min(ts) as started, max(ts) as ended, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type from
(select *, sum(coalesce(g, 0)) over (partition by user_id order by ts, event_id)::bigint as session from
(select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 21600 * 1000000::bigint then 1 else 0 end as g from events)) group by 1, 2""")
def journey_summary(spark, sf):
    s = temporal.sessions(table(spark, sf, "events"), "user_id", "ts", 21_600, "event_id")
    key = F.struct("ts", "event_id")
    return s.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("value")).alias("total"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.min_by("event_type", key).alias("first_type"), F.max_by("event_type", key).alias("last_type"),
    )


@query("select event_id, case when degrees(atan2(dx, dy)) < 0 then round(degrees(atan2(dx, dy)) + 360, 4) else round(degrees(atan2(dx, dy)), 4) end as bearing from (select event_id, value - lag(value) over w as dx, (event_id % 7 - 3.5)::double as dy from events window w as (partition by user_id order by ts, event_id)) where dx is not null")
def bearings(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = table(spark, sf, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("dx"), (F.col("event_id") % 7 - 3.5).alias("dy")).filter("dx is not null")
    return df.select("event_id", _r(geo.bearing_degrees(F.col("dx"), F.col("dy"))).alias("bearing"))


@query("""with h as (select distinct user_id, hour(ts) as h, ts::date as day from events), c as (select user_id, h, count(*) as days, row_number() over (partition by user_id order by count(*) desc, h) as k from h group by 1, 2) select user_id, h as busiest_hour, days from c where k = 1""")
def busiest_hour(spark, sf):
    h = table(spark, sf, "events").select("user_id", F.hour("ts").cast("long").alias("h"), F.to_date("ts").alias("day")).distinct()
    c = h.groupBy("user_id", "h").agg(F.count(F.lit(1)).alias("days"))
    best = c.groupBy("user_id").agg(F.max(F.struct("days", (-F.col("h")).alias("m"))).alias("x"))
    return best.select("user_id", (-F.col("x.m")).alias("busiest_hour"), "x.days")


@query(f"with s as ({_SUPPLIERS}), d as (select a.id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from s a join s b on a.id <> b.id group by 1) select round(median(d), 4) as buffer, count(*) as n from d")
def leave_one_out_buffer(spark, sf):
    """Median distance to the nearest other point."""
    s = _points(spark, sf, "supplier", "s_suppkey")
    near = spatial.nearest_join(s, s, 8.0, 2).filter("a_id <> b_id").groupBy("a_id").agg(F.min("dist").alias("d"))
    near = materialize(near, "nearest")
    half = ranks.percentiles(near, [], "d", {"buffer": 0.5})
    return half.crossJoin(near.agg(F.count(F.lit(1)).alias("n"))).select(_r("buffer").alias("buffer"), "n")


@query(f"with c as ({_CUSTOMERS}), s as ({_SUPPLIERS}) select s.id, count(c.id) as n, round(coalesce(sum(c_acctbal), 0), 2) as total, arg_max(c.id, (c_acctbal, c.id)) as largest from s left join (c join customer on c_custkey = c.id) on sqrt(pow(s.x - c.x, 2) + pow(s.y - c.y, 2)) <= 6 group by 1")
def points_near_sites(spark, sf):
    """Count, sum and largest of the points near each site; a site without any counts zero."""
    # What lies in one place is summed up first, and sites in one place look around once.
    balance = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), geo.synthetic_lon(F.col("c_custkey")).alias("x"), geo.synthetic_lat(F.col("c_custkey")).alias("y"), "c_acctbal")
    held = balance.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"), F.max(F.struct("c_acctbal", "id")).alias("top"))
    held = materialize(held.withColumn("id", F.monotonically_increasing_id()), "held")
    sites = _points(spark, sf, "supplier", "s_suppkey")
    spots = spatial.distinct_places(sites)
    met = spatial.within_distance(spots, held, 6.0).join(held.select(F.col("id").alias("b_id"), "n", "total", "top"), "b_id")
    agg = met.groupBy("a_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    near = materialize(agg.join(spots.withColumnRenamed("id", "a_id"), "a_id").select("x", "y", "n", "total", F.col("top.id").alias("largest")), "near")
    return sites.join(near, ["x", "y"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "largest")


@query(f"""with {_GRID}, s as ({_SUPPLIERS}), p as (select id, cast(floor(x / 12) as bigint) as cx, cast(floor(y / 12) as bigint) as cy from s) select id, round(value, 2) as value from p left join g using (cx, cy)""")
def sample_raster(spark, sf):
    p = _points(spark, sf, "supplier", "s_suppkey").select("id", geo.cell(F.col("x"), 12).alias("cx"), geo.cell(F.col("y"), 12).alias("cy"))
    return p.join(_grid(spark, sf), ["cx", "cy"], "left").select("id", F.round("value", 2).alias("value"))


@query(f"""with {_GRID}, a as (select cx, cy, case when value > 0 then 1 else 0 end as was, case when value > 500 then 1 else 0 end as now from g) select was || '-' || now as change, count(*) as cells from a group by 1""")
def landcover_transition(spark, sf):
    g = _grid(spark, sf).select((F.col("value") > 0).cast("int").alias("was"), (F.col("value") > 500).cast("int").alias("now"))
    return g.groupBy(F.concat_ws("-", "was", "now").alias("change")).agg(F.count(F.lit(1)).alias("cells"))


@query(f"""with {_GRID}, s as ({_SUPPLIERS}), b as (select cast(floor(x / 12) as bigint) as cx, cast(floor(y / 12) as bigint) as cy, count(*) as m from s group by 1, 2), n as (select cast(floor(x / 12) as bigint) as cx, cast(floor(y / 12) as bigint) as cy, count(*) as n from c group by 1, 2)
select coalesce(n.cx, b.cx) as cx, coalesce(n.cy, b.cy) as cy, coalesce(n, 0) - coalesce(m, 0) as diff from n full join b on n.cx = b.cx and n.cy = b.cy""")
def compare_sources(spark, sf):
    """Counts of two point sources per cell, subtracted."""
    count = lambda name, key, to: _points(spark, sf, name, key).groupBy(geo.cell(F.col("x"), 12).alias("cx"), geo.cell(F.col("y"), 12).alias("cy")).agg(F.count(F.lit(1)).alias(to))
    both = count("customer", "c_custkey", "n").join(count("supplier", "s_suppkey", "m"), ["cx", "cy"], "full")
    return both.select("cx", "cy", (F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("diff"))


@query(f"""with {_GRID} select cast(count(*) filter (where value > 0) as bigint) as built, cast(count(*) filter (where value > 0 and cy < 0) as bigint) as flooded, round(count(*) filter (where value > 0 and cy < 0) / count(*) filter (where value > 0), 6) as share from g""")
def flood_exposure(spark, sf):
    built, wet = F.sum((F.col("value") > 0).cast("int")), F.sum(((F.col("value") > 0) & (F.col("cy") < 0)).cast("int"))
    return _grid(spark, sf).agg(built.alias("built"), wet.alias("flooded"), F.round(wet / built, 6).alias("share"))


@query("""with a as (select s_nationkey, sum(s_acctbal) filter (where s_acctbal > 0) as w from supplier group by 1), t as (select sum(w) as w, count(*) as n, avg(w) as m, stddev_pop(w) as s from a), c as (select a.w / sum(a.w) over () as z, count(*) over () as n, sum(a.w) over () / t.w as share from a, t where a.w > t.m)
select round(-sum(z * ln(z)) / ln(max(n)) * max(n) * max(share), 6) as polycentricity from c having max(n) > 1""")
def polycentricity(spark, sf):
    """Entropy of the centres (zones above the mean), times their number and their share of the total."""
    a = table(spark, sf, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("w"))
    t = F.broadcast(a.agg(F.sum("w").alias("all"), F.avg("w").alias("mean")))
    c = a.crossJoin(t).filter("w > mean")
    total = F.broadcast(c.agg(F.sum("w").alias("top"), F.count(F.lit(1)).alias("n")))
    z = F.col("w") / F.col("top")
    out = c.crossJoin(total).agg((-F.sum(z * F.log(z))).alias("h"), F.max("n").alias("n"), (F.max("top") / F.max("all")).alias("share")).filter("n > 1")
    return out.select(F.round(F.col("h") / F.log("n") * F.col("n") * F.col("share"), 6).alias("polycentricity"))


@query("""with n as (select c_nationkey as k, count(*) as p, ((c_nationkey * 37) % 360 - 180)::double as x, ((c_nationkey * 17) % 180 - 90)::double as y from customer group by 1) select round(sum(a.p * b.p / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / sum(distinct t.p), 4) as compactness from n a join n b on a.k <> b.k, (select sum(p) as p from n) t""")
def compactness(spark, sf):
    """Gravity compactness of the zones: each population times the others over their distance, over the total."""
    k = F.col("c_nationkey")
    n = table(spark, sf, "customer").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("p")).select("k", "p", geo.synthetic_lon(F.col("k")).alias("x"), geo.synthetic_lat(F.col("k")).alias("y"))
    pair = n.alias("a").join(broadcast_if_small(n, 20_000).alias("b"), F.col("a.k") != F.col("b.k"))
    dist = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    total = F.broadcast(n.agg(F.sum("p").alias("total")))
    return pair.crossJoin(total).agg(_r(F.sum(F.col("a.p") * F.col("b.p") / dist) / F.max("total")).alias("compactness"))


@query("""with s as (select p_brand, sum(p_size) as a from part group by 1), t as (select sum(a) as t, count(*) as n from s) select round(exp(sum(ln(1 - abs(1.0 / n - a / t)))), 6) as mix from s, t""")
def land_use_mix(spark, sf):
    """Product over the classes of one minus the gap between expected and actual share."""
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("a"))
    t = F.broadcast(s.agg(F.sum("a").alias("t"), F.count(F.lit(1)).alias("n")))
    return s.crossJoin(t).agg(F.round(F.exp(F.sum(F.log(1 - F.abs(1.0 / F.col("n") - F.col("a") / F.col("t"))))), 6).alias("mix"))


@query("with recursive " + OD + """ select o, cast(sum(case when cost < 15 then w_d else 0 end) as bigint) as within_15, cast(sum(case when cost < 30 then w_d else 0 end) as bigint) as within_30, cast(sum(case when cost < 60 then w_d else 0 end) as bigint) as within_60 from od group by 1""")
def jobs_within(spark, sf):
    from geoloom.operators.access import within_thresholds

    return within_thresholds(ng3_od(spark, sf), [15, 30, 60], "w_d")


@query("with recursive " + OD + """, m as (select o, w_o, min(cost) filter (where o <> d) as t from od group by 1, 2) select case when t <= 10 then 0 when t <= 20 then 1 when t <= 40 then 2 else 3 end as bin, cast(sum(w_o) as bigint) as pop, round(sum(w_o) / (select sum(w_o) from m), 6) as share from m group by 1""")
def time_category_shares(spark, sf):
    m = ng3_od(spark, sf).groupBy("o", "w_o").agg(F.min(F.when(F.col("o") != F.col("d"), F.col("cost"))).alias("t"))
    b = m.groupBy(F.when(F.col("t") <= 10, 0).when(F.col("t") <= 20, 1).when(F.col("t") <= 40, 2).otherwise(3).alias("bin")).agg(F.sum("w_o").alias("pop"))
    return b.select("bin", "pop", F.round(F.col("pop") / F.sum("pop").over(Window.partitionBy()), 6).alias("share"))


@query("with recursive " + OD + """ select d, round(sum(w_o * cost) / sum(w_o), 6) as mean_cost, round(stddev_pop(cost), 6) as sd, count(*) as origins from od where o <> d group by 1""")
def weighted_od_summary(spark, sf):
    c, w = F.col("cost"), F.col("w_o")
    return ng3_od(spark, sf).filter("o <> d").groupBy("d").agg(F.round(F.sum(w * c) / F.sum(w), 6).alias("mean_cost"), F.round(F.stddev_pop("cost"), 6).alias("sd"), F.count(F.lit(1)).alias("origins"))


@query("with " + NG3 + """, r as (select u, v from ng3 union select v, u from ng3), p as (select a.u, a.v as x, b.v as y from r a join r b on a.u = b.u and a.v < b.v), t as (select p.u, count(*) as pairs, count(r.u) as closed from p left join r on r.u = x and r.v = y group by 1)
select u, pairs, closed, round(closed / pairs, 6) as clustering from t""")
def clustering(spark, sf):
    """Share of each node's pairs of neighbours that are neighbours of each other."""
    return graph.clustering(ng3(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query("""with recursive """ + OD + """ select o, count(*) - 1 as reached, round((count(*) - 1) / nullif(sum(cost), 0), 6) as closeness from od group by 1""")
def closeness(spark, sf):
    n = F.count(F.lit(1)) - 1
    return ng3_od(spark, sf).groupBy("o").agg(n.alias("reached"), F.round(n / F.nullif(F.sum("cost"), F.lit(0.0)), 6).alias("closeness"))


@query("""select v, u, round(length, 4) as length from (select u, v, length, row_number() over (partition by least(u, v), greatest(u, v) order by length, u, v, k) as r, min(length) over (partition by least(u, v), greatest(u, v)) as m
from (select l_suppkey % 20 as u, l_partkey % 20 as v, l_quantity as length, l_orderkey * 10 + l_linenumber as k from lineitem)) where r = 1 or length >= 1.5 * m""")
def drop_clone_edges(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("u"), (F.col("l_partkey") % 20).alias("v"), F.col("l_quantity").alias("length"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return graph.drop_clones(e, 1.5, "length", ["k"]).select("v", "u", _r("length").alias("length"))


@query("""select c_custkey, cast(count(*) over (partition by c_nationkey, c_mktsegment) > 1 as int) as shared, cast(row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) > 1 as int) as again from customer""")
def duplicate_flags(spark, sf):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    n, k = F.count(F.lit(1)).over(w) > 1, F.row_number().over(w.orderBy("c_custkey")) > 1
    return table(spark, sf, "customer").select("c_custkey", n.cast("int").alias("shared"), k.cast("int").alias("again"))


@query("""select p_partkey, round(least(greatest((p_retailprice - lo) / (hi - lo), 0), 1) * 255, 4) as scaled from part, (select quantile_cont(p_retailprice, 0.02) as lo, quantile_cont(p_retailprice, 0.98) as hi from part)""")
def percentile_scale(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    ends = F.broadcast(ranks.percentiles(p, [], "p_retailprice", {"lo": 0.02, "hi": 0.98}))
    x = (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return p.crossJoin(ends).select("p_partkey", _r(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).alias("scaled"))


@query("""select l_orderkey, l_linenumber, round(l_quantity * 100.0 / (l_quantity + l_discount * 100 + l_tax * 100), 4) as pct_quantity, case when l_quantity >= l_discount * 100 and l_quantity >= l_tax * 100 then 'quantity' when l_discount >= l_tax then 'discount' else 'tax' end as dominant from lineitem""")
def row_shares(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    top = F.when((q >= d) & (q >= t), "quantity").when(F.col("l_discount") >= F.col("l_tax"), "discount").otherwise("tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(q * 100.0 / (q + d + t)).alias("pct_quantity"), top.alias("dominant"))


@query("""select o_orderkey, least(o_totalprice, nullif(c_acctbal, 0)) as plot, case when c_acctbal < o_totalprice then 'walk' else 'net' end as choice from orders join customer on o_custkey = c_custkey""")
def mode_choice(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    df = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return df.select("o_orderkey", F.least("o_totalprice", F.nullif("c_acctbal", F.lit(0.0))).alias("plot"), F.when(F.col("c_acctbal") < F.col("o_totalprice"), "walk").otherwise("net").alias("choice"))


@query("""with a as (select o_custkey as k, count(*) as n0 from orders where year(o_orderdate) = 1996 group by 1), b as (select o_custkey as k, count(*) as n1 from orders where year(o_orderdate) = 1997 group by 1)
select c_custkey, case when n0 is not null and n1 is not null then 'unchanged' when n0 is not null then 'newly_destroyed' when n1 is not null then 'rebuilt' else 'always_destroyed' end as change from customer left join a on a.k = c_custkey left join b on b.k = c_custkey""")
def facility_change(spark, sf):
    o = table(spark, sf, "orders").filter(F.year("o_orderdate").isin(1996, 1997))
    seen = o.groupBy("o_custkey").agg(F.max(F.year("o_orderdate") == 1996).alias("was"), F.max(F.year("o_orderdate") == 1997).alias("now"))
    df = table(spark, sf, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return df.select("c_custkey", F.when(was & now, "unchanged").when(was, "newly_destroyed").when(now, "rebuilt").otherwise("always_destroyed").alias("change"))


@query("""with d as (select s_nationkey as k, 1 as svc, count(*) as n from supplier group by 1 union all select c_nationkey, 2, count(*) from customer where c_acctbal < 0 group by 1), t as (select k, cast(sum(n) as bigint) as score from d group by 1) select k, score, rank() over (order by score desc) as place from t""")
def composite_score(spark, sf):
    """Head counts of two services joined into one score and ranked: one row a nation enters the ranking."""
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    t = a.unionByName(b).groupBy("k").agg(F.sum("n").alias("score"))
    return t.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))).cast("long"))
