"""Readers and writers over small files, ranks of groups, and the home-range state."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from geoloom.operators import ranks
from geoloom.sources import readers, writers
from geoloom.streaming.home_range import home_range


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_graph_files(spark, tmp_path):
    combo = put(tmp_path / "combo.csv", 'u,v,length\n"(1.5, -2)","(3, 4)",7\n"(3, 4)","bad",1\n')
    nodes, edges = readers.combo_csv(spark, combo)
    assert {(r["x"], r["y"]) for r in nodes.collect()} == {(1.5, -2.0), (3.0, 4.0), (None, None)} and edges.count() == 2
    n = put(tmp_path / "n.csv", "node_ID,x\n1,5\n2,6\n3,7\n")
    e = put(tmp_path / "e.csv", "stnode,endnode\n1,2\n")
    nodes, edges = readers.node_edge_csv(spark, n, e)
    assert {r["node"] for r in nodes.collect()} == {"1", "2"} and edges.columns == ["u", "v"]
    writers.save_graph(nodes, edges, str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved" / "edges")).count() == 1


def test_osm_and_geojson(spark, tmp_path):
    osm = put(tmp_path / "a.osm", '<osm><node id="1" lat="2.5" lon="3.5"/><node id="2" lat="0" lon="0"/><way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="8"><nd ref="2"/></way></osm>')
    nodes, ways = readers.osm_xml(spark, osm)
    assert {(r["node"], r["x"], r["y"]) for r in nodes.collect()} == {(1, 3.5, 2.5), (2, 0.0, 0.0)}
    assert {r["way_id"]: r["nds"] for r in ways.collect()} == {9: [1, 2], 8: [2]}
    assert [r["way_id"] for r in readers.accepted_roads(ways, ["primary"]).collect()] == [9] == [r["way_id"] for r in readers.accepted_roads(ways, []).collect()]
    features = writers.as_geojson(spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double"), "x", "y").collect()[0]["feature"]
    path = put(tmp_path / "g.json", f'{{"type":"FeatureCollection","features":[{features}]}}')
    row = readers.geojson(spark, path).collect()[0]
    assert row["type"] == "Point" and row["coordinates"].replace(" ", "") == "[2.0,3.0]" and '"id":1' in row["properties"]


def test_matrices_and_surveys(spark, tmp_path):
    wide = put(tmp_path / "od.csv", "o,1,2\n1, 0,5\n2,7, \n")
    long = readers.wide_od_csv(spark, wide)
    assert {tuple(r) for r in long.collect()} == {(1, 1, 0.0), (1, 2, 5.0), (2, 1, 7.0)}
    back = writers.wide_matrix(long, [1, 2], "flow")
    assert {r["o"]: (r["1"], r["2"]) for r in back.collect()} == {1: (0.0, 5.0), 2: (7.0, None)}
    survey = put(tmp_path / "s.csv", "id,lat,lon\n1,5,6\n2,999,6\n3,,6\n4,5,99.0\n")
    assert [r["id"] for r in readers.survey_csv(spark, survey, "lat", "lon").collect()] == ["1"]
    broken = put(tmp_path / "b.csv", '"name","valu"\n"a","1",,\n"b","2"\n')
    assert {(r["name"], r["value"]) for r in readers.repaired_csv(spark, broken, ["name", "value"], {"valu": "value"}).collect()} == {("a", "1"), ("b", "2")}


def test_folders_and_feeds(spark, tmp_path):
    put(tmp_path / "d" / "x" / "a.TIF", "123")
    put(tmp_path / "d" / "x" / "b.tif", "4567")
    put(tmp_path / "d" / "c.csv", "1")
    census = {(r["folder"].rsplit("/", 1)[1], r["kind"]): (r["files"], r["bytes"]) for r in readers.folder_census(spark, str(tmp_path / "d")).collect()}
    assert census == {("x", "tif"): (2, 7), ("d", "csv"): (1, 1)}
    stops = spark.createDataFrame([("t", "10", "B", "10:10:00", "10:11:00"), ("t", "9", "A", "09:00:00", "10:00:00"), ("t", "11", "C", "25:00:00", "25:00:00"), ("z", "1", "A", "1:00:00", "1:00:00")], "trip_id string, stop_sequence string, stop_id string, arrival_time string, departure_time string")
    trips, services = spark.createDataFrame([("t", "r", "s"), ("z", "r", "no")], "trip_id string, route_id string, service_id string"), spark.createDataFrame([("s",)], "service_id string")
    assert {(r["u"], r["v"], r["seconds"]) for r in readers.gtfs_legs(stops, trips, services).collect()} == {("A", "B", 600.0), ("B", "C", 53_340.0)}


def test_ranks_running_sums_and_percentiles_of_skewed_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab") if rng.random() < 0.95 else None, i, float(rng.randrange(50))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = {r["i"]: (r["rank"], r["running"]) for r in ranks.running(df, ["g"], ["v", "i"], "v").collect()}
    for g in ("a", "b", None):
        total = 0.0
        for k, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            total += v
            assert got[i] == (k, total)
    out = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in ranks.percentiles(df, ["g"], "v", {"lo": 0.0, "mid": 0.37, "hi": 1.0}).collect()}
    for g in ("a", "b", None):
        v = sorted(r[2] for r in rows if r[0] == g)
        at = 0.37 * (len(v) - 1)
        mid = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
        assert out[g][0] == v[0] and out[g][2] == v[-1] and abs(out[g][1] - mid) < 1e-9


def test_home_range_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    rows = [(u, (u * i * 7) % 5, i) for u in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "user_id long, cell long, i int")
    for k in range(3):
        df.filter(F.col("i") % 3 == k).drop("i").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, cell long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict[int, tuple] = {}

    def keep(batch, _):
        seen.update({r["user_id"]: tuple(r) for r in batch.collect()})

    q = home_range(stream, "cell").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert seen == {r["user_id"]: tuple(r) for r in home_range(df, "cell").collect()}


def test_capacities_move_the_farthest_on(spark):
    from geoloom.operators.locate import capacitated

    od = spark.createDataFrame([(o, d, float(abs(10 * d - o)), 1.0) for o in range(10) for d in (0, 1)], "o long, d long, cost double, w_o double")
    sites = spark.createDataFrame([(0,), (1,)], "d long")
    out = {r["o"]: r["d"] for r in capacitated(od, sites, spark.createDataFrame([(0, 3.0), (1, 6.0)], "d long, cap double")).collect()}
    assert out == {0: 0, 1: 0, 2: 0, **{o: 1 for o in range(4, 10)}}  # origin 3 fits nowhere
