"""Further registered queries: filters, formulas, summaries, ranks and what the readers' tables need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geo, weights
from geoloom.operators import demand, graph, ranks, raster, temporal
from geoloom.plans.catalog import OD, _r, ng3_od, query
from geoloom.plans.materialize import materialize
from geoloom.sources.tables import table


# --- filters and columns ------------------------------------------------------------


@query("select event_id, value as accuracy from events where value < 100 and value is not null and user_id is not null")
def gps_quality(spark, sf):
    """Pings whose horizontal accuracy is better than 100 m."""
    return temporal.accurate_pings(table(spark, sf, "events").withColumn("accuracy", F.col("value")), "accuracy", 100).filter("user_id is not null").select("event_id", "accuracy")


@query("""with s as (select user_id, session, sum(value) * 100 as dist, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 as secs from
(select *, sum(coalesce(g, 0)) over (partition by user_id order by ts, event_id) as session from
(select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 21600 * 1000000::bigint then 1 else 0 end as g from events)) group by 1, 2)
select user_id, cast(session as bigint) as session, round(dist, 4) as dist, round(dist / secs * 3600 / 1609.34, 4) as mph from s where secs > 0 and dist > 100 and dist / secs * 3600 / 1609.34 > 0.1 and dist / secs * 3600 / 1609.34 < 120""")
def journey_plausible(spark, sf):
    """Journeys of over 100 m at 0.1 to 120 miles an hour."""
    s = temporal.sessions(table(spark, sf, "events"), "user_id", "ts", 21_600, "event_id").groupBy("user_id", "session")
    j = s.agg((F.sum("value") * 100).alias("dist"), temporal.seconds_between(F.max("ts"), F.min("ts")).alias("seconds"))
    return temporal.plausible_journeys(j, "dist", "seconds").select("user_id", "session", _r("dist").alias("dist"), _r("mph").alias("mph"))


@query("select p_partkey as \"KEY\", p_size as \"X_P_SIZE\", p_retailprice as \"X_P_RETAILPRICE\" from part")
def renamed_columns(spark, sf):
    """Columns picked by a pattern, in upper case, with a prefix."""
    p = table(spark, sf, "part")
    picked = [c for c in p.columns if __import__("re").match(r"p_(size|retail)", c)]
    return p.select(F.col("p_partkey").alias("KEY"), *(F.col(c).alias(f"X_{c.upper()}") for c in picked))


@query("select s_suppkey, 10 * cast(s_acctbal / 10000 > 0.6 as int) + cast(s_suppkey % 7 / 10.0 > 0.23156 as int) as flags from supplier")
def electrification_flags(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", weights.electrified(F.col("s_acctbal") / 10000, F.col("s_suppkey") % 7 / 10.0).alias("flags"))


@query("""select p_partkey, case when p_size > 20 then p_size else 20 end as speed, round(p_size * 50.0 / 1000 / 4.5 * 3600, 4) as snap, round(case when p_size > 0 then p_retailprice / p_size * 3600 / 1609.34 end, 4) as mph,
round(greatest(least((p_retailprice - p_size * 30) / nullif(p_retailprice + p_size * 30, 0), 1), -1), 6) as ndvi, round(round(p_retailprice / pow(10, floor(log10(p_retailprice)))) * pow(10, floor(log10(p_retailprice))), 4) as one_digit from part""")
def speed_formulas(spark, sf):
    """Observed speed with a fallback, walking time to the node, planar speed, normalised difference, one significant digit."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", weights.observed_speed(F.when(size > 20, size), F.lit(20)).alias("speed"), _r(weights.snap_seconds(size * 50.0)).alias("snap"), _r(weights.mph(price, size)).alias("mph"),
        F.round(weights.normalized_index(price, size * 30), 6).alias("ndvi"), _r(weights.round_significant(price)).alias("one_digit"),
    )


@query("""select p_partkey, round((p_size * 1000.0 / 1000 * case p_type when 'ECONOMY' then 0.05 when 'PROMO' then 0.12 else 0.08 end + 2.5) / 1000, 8) as per_kg, round(ln(p_retailprice) / ln(2.0), 6) as log2, cast(floor(least(greatest((p_retailprice - 1000) / 500.0, 0), 1) * 255) as bigint) as byte,
round((p_size * 0.01 - 0.1) / sin(radians(30 + p_size)), 6) as reflectance from part""")
def cost_and_band_formulas(spark, sf):
    """Transport cost a kilogram, logarithm to a base, byte scale, reflectance."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    rate = weights.lookup(F.col("p_type"), {"ECONOMY": 0.05, "PROMO": 0.12}, 0.08)
    return table(spark, sf, "part").select(
        "p_partkey", F.round(weights.transport_cost(size * 1000.0, rate, 2.5), 8).alias("per_kg"), F.round(weights.log_base(price, 2), 6).alias("log2"),
        weights.byte_scale(price, 1000, 1500).alias("byte"), F.round(weights.reflectance(size, 0.01, -0.1, 30 + size), 6).alias("reflectance"),
    )


@query("""select c_custkey, case when lat >= 0 then 'N' else 'S' end || lpad(cast(abs(floor(lat))::bigint as varchar), 2, '0') || case when lon >= 0 then 'E' else 'W' end || lpad(cast(abs(floor(lon))::bigint as varchar), 3, '0') as tile
from (select c_custkey, ((c_custkey * 37) % 360 - 180)::double as lon, ((c_custkey * 17) % 180 - 90)::double as lat from customer)""")
def tile_codes(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", weights.tile_code(geo.synthetic_lon(k), geo.synthetic_lat(k)).alias("tile"))


@query("""with d as (select p_partkey, p_size * 3.0 as secs, case when p_size / 5.0 > 0 and p_size / 5.0 < 10 then p_size / 5.0 else 0 end as a, case when p_partkey % 13 > 0 and p_partkey % 13 < 10 then p_partkey % 13 else 0 end as b from part)
select p_partkey, round(case when greatest(a, b) >= 6 then 99999999 when greatest(a, b) > 0 then secs * 6 / (6 - greatest(a, b)) else secs end, 4) as seconds from d""")
def flood_slowdown(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", _r(weights.flood_seconds(size * 3.0, size / 5.0, (F.col("p_partkey") % 13).cast("double"), 6.0, 99_999_999)).alias("seconds"))


@query("select p_partkey, round(p_retailprice * case when p_size < 5 then 1.0 when p_size > 16 then 0.5 else 1 - 0.5 * (p_size - 5) / 11.0 end, 4) as speed from part")
def iri_speed(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _r(F.col("p_retailprice") * weights.roughness_factor(F.col("p_size"))).alias("speed"))


@query("""select o_custkey as u, o_orderkey as v, round(coalesce(t, o_totalprice), 4) as seconds, cast(t is not null as int) as observed from orders left join (select l_orderkey, sum(l_quantity) as t from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey""")
def replaced_times(spark, sf):
    """Travel times replaced by observed ones where the edge has any, with a flag."""
    seen = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("v")).agg(F.sum("l_quantity").alias("seconds"))
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("seconds"))
    return graph.replace_cost(edges, seen, ["v"], "seconds").withColumn("seconds", _r("seconds"))


@query("select l_orderkey, l_linenumber, least(l_linenumber, cast(l_quantity as int) % 5 + 1) * 1800 as capacity from lineitem")
def link_capacity(spark, sf):
    lanes = F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int") % 5 + 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", weights.link_capacity(lanes, 1800).alias("capacity"))


@query("""select brand, cast(row_number() over (order by split_part(brand, '#', 1), cast(split_part(brand, '#', 2) as int)) as bigint) as place from (select distinct p_brand as brand from part)""")
def natural_sort(spark, sf):
    """Names in the order in which their numbers compare as numbers: the distinct names alone are ranked."""
    names = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("_key", weights.natural_key(F.col("brand")))
    return ranks.running(names, [], ["_key"]).select("brand", (F.col("rank") + 1).alias("place"))


# --- road and admin summaries -------------------------------------------------------


@query("""select l_shipmode as road, round(total, 4) as measured, round(good / total, 6) as share_good, round(iri / total, 6) as mean_iri from (select l_returnflag as l_shipmode, sum(l_quantity) filter (where l_linestatus <> 'O') as total,
sum(l_quantity) filter (where l_linestatus = 'F' and l_tax < 0.04) as good, sum(case when l_linestatus <> 'O' and l_discount > 0 then l_discount * l_quantity end) as iri from lineitem group by 1)""")
def condition_summary(spark, sf):
    """Length-weighted condition and roughness by road: unmeasured parts count nowhere, blank roughness only in the denominator."""
    e = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("road"), F.col("l_quantity").alias("length"), F.when(F.col("l_linestatus") == "O", "NOT MEASURED").when(F.col("l_tax") < 0.04, "GOOD").otherwise("BAD").alias("condition"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("iri"),
    )
    out = graph.condition_summary(e, ["road"])
    return out.select("road", _r("measured").alias("measured"), F.round(F.col("GOOD") / F.col("measured"), 6).alias("share_good"), F.round("mean_iri", 6).alias("mean_iri"))


@query("""select p_type as class, round(sum(p_size * 1.0), 4) as km from part group by 1""")
def length_by_class(spark, sf):
    """Length by road class; of a list of classes the first counts."""
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(";LARGE"))).otherwise(F.col("p_type")).alias("classes"), (F.col("p_size") * 1000.0).alias("length"))
    return graph.length_by_class(p.withColumn("classes", F.split("classes", ";"))).withColumn("km", _r("km"))


@query("""select round(sum(p_size * 100.0) / 1000 / (sum(p_size * 100.0 / 1000 / (20 + p_size % 30) * 3600) / 3600), 6) as kmh from part""")
def network_average_speed(spark, sf):
    size = F.col("p_size")
    e = table(spark, sf, "part").select((size * 100.0).alias("length"), weights.travel_seconds(size * 100.0, 20 + size % 30).alias("seconds"))
    return graph.average_speed(e).withColumn("kmh", F.round("kmh", 6))


@query("""select p_type as class, round(coalesce(avg(case when p_size - 25 > 0 then p_size - 25 end), 0), 6) as kmh from part group by 1""")
def class_traffic_speed(spark, sf):
    """Mean observed speed by class; only positive speeds count, a class without any has 0."""
    e = table(spark, sf, "part").select(F.col("p_type").alias("class"), (F.col("p_size") - 25).alias("mean_speed"))
    return graph.class_speed(e).withColumn("kmh", F.round("kmh", 6))


@query("""select n_regionkey as admin, round(sum(case when c_acctbal >= 3000 then c_acctbal else 0 end), 2) as urban, round(sum(case when c_acctbal < 3000 then c_acctbal else 0 end), 2) as rural,
round(sum(case when c_acctbal < 3000 then c_acctbal else 0 end) / sum(c_acctbal), 6) as rural_share, case when sum(case when c_acctbal < 3000 then c_acctbal else 0 end) / sum(c_acctbal) > 0.5 then 'Rural' when sum(case when c_acctbal < 3000 then c_acctbal else 0 end) / sum(c_acctbal) > 0.2 then 'Intermediate' else 'Urban' end as class
from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by 1""")
def urban_rural_pivot(spark, sf):
    """Urban and rural population of each admin unit with the rural share and its class."""
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("admin")))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("admin", F.when(F.col("c_acctbal") >= 3000, "urban").otherwise("rural").alias("kind"), F.col("c_acctbal").alias("pop"))
    p = c.groupBy("admin").pivot("kind", ["urban", "rural"]).agg(F.sum("pop")).fillna(0.0)
    share = F.col("rural") / (F.col("urban") + F.col("rural"))
    return p.select("admin", F.round("urban", 2).alias("urban"), F.round("rural", 2).alias("rural"), F.round(share, 6).alias("rural_share"), weights.urban_class(share).alias("class"))


@query("""select p_type, cast(sum(case when p_size >= 40 then 1 else 0 end) as bigint) as built_1975, cast(sum(case when p_size >= 30 then 1 else 0 end) as bigint) as built_1990, cast(sum(case when p_size >= 20 then 1 else 0 end) as bigint) as built_2000, cast(sum(case when p_size >= 10 then 1 else 0 end) as bigint) as built_2014 from part group by 1""")
def built_epochs(spark, sf):
    """Cells built by each epoch: a value of at least the epoch's code means built by then (GHSL-like layers, cumulative)."""
    cells = table(spark, sf, "part").select(F.col("p_type").alias("zone"), F.col("p_size").alias("value"))
    return raster.built_by_epoch(cells, {1975: 40, 1990: 30, 2000: 20, 2014: 10}).withColumnRenamed("zone", "p_type")


@query("""select n_nationkey as zone, round(coalesce(sum(case when c_acctbal >= 5000 then c_acctbal end), 0), 2) as urban_lights, round(coalesce(sum(case when c_acctbal < 5000 and c_acctbal >= 1000 then c_acctbal end), 0), 2) as rural_lights from nation left join customer on c_nationkey = n_nationkey group by 1""")
def night_light_sums(spark, sf):
    """Night light above the noise floor, by zone, in urban and in rural cells."""
    cells = table(spark, sf, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("value"), (F.col("c_acctbal") >= 5000).alias("urban"))
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone"))
    return raster.light_sums(cells, zones, 1000.0).select("zone", F.round("urban_lights", 2).alias("urban_lights"), F.round("rural_lights", 2).alias("rural_lights"))


@query("""select c_nationkey as footprint, case when count(*) = 1 then 'city' else 'agglomeration' end as kind, arg_max(c_name, (c_acctbal, c_custkey)) as main_city, round(sum(c_acctbal), 2) as pop, count(*) as cities from customer where c_acctbal > 9500 group by 1""")
def agglomerations(spark, sf):
    """Footprints with the cities inside: one is a city, several an agglomeration named by its largest."""
    c = table(spark, sf, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("footprint"), F.col("c_name").alias("city"), F.col("c_acctbal").alias("pop"), "c_custkey")
    return raster.agglomerations(c, "c_custkey").withColumn("pop", F.round("pop", 2))


@query("""select p_partkey as image, cast(row_number() over (order by (case when p_size < 10 then 3 when p_size < 30 then 2 else 1 end) * 0.5 + (p_retailprice - 900) / 1200 * 0.5 desc, p_partkey) as bigint) as place from part where p_size <= 45 and p_retailprice > 905""")
def image_ranking(spark, sf):
    """Scenes that pass the screens (cloud, overlap), ranked by weighted points."""
    points = F.when(F.col("p_size") < 10, 3).when(F.col("p_size") < 30, 2).otherwise(1) * 0.5 + (F.col("p_retailprice") - 900) / 1200 * 0.5
    p = table(spark, sf, "part").filter("p_size <= 45 and p_retailprice > 905").select(F.col("p_partkey").alias("image"), (-points).alias("_p"))
    return ranks.running(p, [], ["_p", "image"]).select("image", (F.col("rank") + 1).alias("place"))


@query("""with s as (select p_retailprice as v, cume_dist() over (order by p_retailprice) as q from part), ss as (select distinct v, q from s), r as (select distinct o as t, q from (select c_acctbal as o, cume_dist() over (order by c_acctbal) as q from customer)),
lo as (select v, ss.q, max(r.q) as ql from ss left join r on r.q <= ss.q group by 1, 2), hi as (select v, min(r.q) as qh from ss join r on r.q >= ss.q group by 1)
select lo.v as value, round(case when a.t is null then b.t when b.t is null or a.q = lo.q then a.t else a.t + (lo.q - a.q) / (b.q - a.q) * (b.t - a.t) end, 4) as matched from lo left join hi using (v) left join r a on a.q = ql left join r b on b.q = qh""")
def histogram_match(spark, sf):
    """Values moved to where the reference distribution has the same cumulative share."""
    p, c = table(spark, sf, "part").select(F.col("p_retailprice").alias("value")), table(spark, sf, "customer").select(F.col("c_acctbal").alias("value"))
    return ranks.match_histogram(p, c).withColumn("matched", _r("matched"))


@query("""with l as (select l_orderkey, l_linenumber, l_quantity from lineitem) select l_orderkey, arg_max(l_linenumber, (l_quantity, l_linenumber)) as part, max(l_quantity) as length from l group by 1""")
def longest_part(spark, sf):
    """The longest part of each multi-part line, held as an array of parts."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("length"), F.col("l_linenumber").alias("part"))).alias("parts"))
    best = graph.longest_part(F.col("parts"))
    return lines.select("l_orderkey", best["part"].alias("part"), best["length"].alias("length"))


# --- streaming operators on their batch form ----------------------------------------------


@query("""with s as (select *, sum(coalesce(g, 0)) over (partition by user_id order by ts) as k from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 21600 * 1000000::bigint then 1 else 0 end as g from events))
select user_id, min(ts) as started, count(*) as n from s group by user_id, k""")
def stream_sessions(spark, sf):
    from geoloom.streaming.events import sessions_by_gap

    return sessions_by_gap(table(spark, sf, "events")).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query("select user_id, ts::date as day, count(*) as n, round(min(value), 4) as low, round(max(value), 4) as high from events group by 1, 2")
def stream_daily(spark, sf):
    from geoloom.streaming.events import daily_by_user

    return daily_by_user(table(spark, sf, "events")).select("user_id", "day", "n", _r("low").alias("low"), _r("high").alias("high"))


@query("""with d as (select user_id, ts::date as day, sum(value) as total from events group by 1, 2), k as (select user_id, unnest(generate_series(day::timestamp, day::timestamp + interval 4 day, interval 1 day))::date as day, total from d)
select user_id, day as last_day, round(sum(total), 4) as total from k group by 1, 2""")
def stream_five_days(spark, sf):
    """Sums over each five days, sliding by a day."""
    from geoloom.streaming.events import sliding_days

    return sliding_days(table(spark, sf, "events"), 5).withColumn("total", _r("total"))


@query("""with d as (select user_id, value as place, ts, event_id, cast(floor(value / 20) as bigint) as cell from events where value is not null), h as (select user_id, cell, count(*) as n from d group by 1, 2), b as (select user_id, arg_max(cell, (n, -cell)) as home from h group by 1)
select user_id, home, (select count(*) from d where d.user_id = b.user_id) as pings, (select count(*) from d where d.user_id = b.user_id and d.cell <> home) as away from b""")
def home_ranges(spark, sf):
    """Each user's most visited cell and how many pings lie outside it."""
    from geoloom.streaming.home_range import home_range

    return home_range(table(spark, sf, "events").filter("value is not null").withColumn("cell", F.floor(F.col("value") / 20)), "cell")


# --- demand, disruption ---------------------------------------------------------------------


@query("""with z as (select c_nationkey as zone, count(*)::double as made, case when c_nationkey % 5 <> 0 then sum(c_acctbal) end as drawn from customer group by 1), f as (select *, coalesce(drawn, (select avg(drawn) from z)) as a from z)
select zone, round(a / (select sum(a) from f) * (select sum(made) from z), 6) as attraction from f""")
def production_attraction(spark, sf):
    z = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count(F.lit(1)).cast("double").alias("made"), F.sum("c_acctbal").alias("_s"))
    z = z.withColumn("drawn", F.when(F.col("zone") % 5 != 0, F.col("_s"))).drop("_s")
    return demand.productions_attractions(z, "made", "drawn").select("zone", F.round("attraction", 6).alias("attraction"))


@query("""with f as (select l_returnflag as product, l_suppkey % 10 as o, l_partkey % 10 as d, sum(l_quantity) as flow from lineitem group by 1, 2, 3) select o, d, round(sum(flow * case product when 'A' then 0.5 when 'N' then 1.0 else 2.0 end), 4) as flow from f group by 1, 2""")
def product_flows(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("product"), (F.col("l_suppkey") % 10).alias("o"), (F.col("l_partkey") % 10).alias("d")).agg(F.sum("l_quantity").alias("flow"))
    factors = spark.createDataFrame([("A", 0.5), ("N", 1.0), ("R", 2.0)], "product string, factor double")
    return demand.combine_products(f, factors).withColumn("flow", _r("flow"))


@query("""select p_partkey, case when p_size % 7 > 0 and p_size % 7 < 5 then 5 when p_size % 11 > 0 and p_size % 11 < 100 then 20 when p_size > 0 and p_size < 100 then 100 else 0 end as first_return from
(select p_partkey, p_size from part)""")
def min_return_period(spark, sf):
    size = F.col("p_size")
    cells = table(spark, sf, "part").select("p_partkey", F.when(size % 7 < 5, size % 7).otherwise(0).alias("y5"), (size % 11).alias("y20"), size.alias("y100"))
    return raster.first_return(cells, [5, 20, 100]).select("p_partkey", "first_return")


@query("with recursive " + OD + """, b as (select o, d, cost as was, w_o * w_d / 100.0::double as flow from od where o <> d), s as (select 's' || k as scenario, o, d, case when (o + d) % 3 = k then null else was * (1 + 0.2 * k) end as now from b, (values (0), (1), (2)) t(k))
select scenario, round(sum(case when now is null then flow else 0 end) / sum(flow), 6) as isolated, round(sum(case when now is not null then flow * (now - was) / was end) / sum(case when now is not null then flow end), 6) as delay,
round(sum(case when now is not null and (now - was) / was > 0.3 then flow else 0 end) / sum(flow), 6) as slowed from s join b using (o, d) group by 1""")
def disruption_shares(spark, sf):
    """Three scenarios of the network's trips, each with a third of the pairs cut and the others slower."""
    od = ng3_od(spark, sf).filter("o <> d")
    base = materialize(od.select("o", "d", "cost", (F.col("w_o") * F.col("w_d") / 100.0).alias("flow")), "od")
    k = spark.range(3).withColumnRenamed("id", "k")
    broken = base.crossJoin(F.broadcast(k)).select(F.concat(F.lit("s"), F.col("k")).alias("scenario"), "o", "d", F.when((F.col("o") + F.col("d")) % 3 != F.col("k"), F.col("cost") * (1 + 0.2 * F.col("k"))).alias("cost"))
    out = demand.disruption_summary(base.drop("flow"), broken, base.select("o", "d", "flow"))
    return out.select("scenario", *(F.round(c, 6).alias(c) for c in ("isolated", "delay", "slowed")))
