"""Readers for network and survey files; each returns plain columns, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import parse_pair


def combo_csv(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a CSV whose columns u and v hold node names "(x, y)"."""
    edges = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)
    x, y = parse_pair(F.col("node"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", x.alias("x"), y.alias("y"))
    return nodes, edges


def node_edge_csv(spark: SparkSession, nodes: str, edges: str, node_col: str = "node_ID", u: str = "stnode", v: str = "endnode") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); only nodes at the end of an edge stay."""
    e = spark.read.csv(edges, header=True).withColumnsRenamed({u: "u", v: "v"})
    n = spark.read.csv(nodes, header=True).withColumnRenamed(node_col, "node")
    used = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    return n.join(used, "node", "left_semi"), e


def osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, x, y), ways(way_id, nds, tags)) of an OSM XML file."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lon double, _lat double").load(path)
    shape = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"
    ways = spark.read.format("xml").option("rowTag", "way").schema(shape).load(path)
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])), F.array().cast("array<struct<_k:string,_v:string>>")))
    return (
        nodes.select(F.col("_id").alias("node"), F.col("_lon").alias("x"), F.col("_lat").alias("y")),
        ways.select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("nds"), tags.alias("tags")),
    )


def accepted_roads(ways: DataFrame, classes: list[str]) -> DataFrame:
    """Ways with a highway tag among the classes; an empty list accepts any."""
    road = F.element_at("tags", "highway")
    return ways.filter(road.isin(classes) if classes else road.isNotNull())


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties as JSON text, type, coordinates as JSON text) of a GeoJSON FeatureCollection."""
    schema = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    one = spark.read.schema(schema).json(path, multiLine=True)
    return one.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def wide_od_csv(spark: SparkSession, path: str) -> DataFrame:
    """(o, d, flow) of a wide matrix whose first column names the origins; blank cells are dropped."""
    wide = spark.read.csv(path, header=True)
    first, *ends = wide.columns
    wide = wide.withColumnRenamed(first, "o")
    long = wide.unpivot(["o"], ends, "d", "text")
    clean = lambda c: F.btrim(F.col(c)).try_cast("long")
    return long.select(clean("o").alias("o"), clean("d").alias("d"), F.btrim("text").try_cast("double").alias("flow")).filter("flow is not null")


def survey_csv(spark: SparkSession, path: str, lat: str, lon: str, sentinels: tuple[float, ...] = (99.0, 999.0)) -> DataFrame:
    """A survey's rows without those whose coordinates are missing or a sentinel."""
    df = spark.read.csv(path, header=True)
    ok = lambda c: F.coalesce(~F.col(c).try_cast("double").isin(*sentinels), F.lit(False))
    return df.filter(ok(lat) & ok(lon))


def repaired_csv(spark: SparkSession, path: str, columns: list[str], misspelt: dict[str, str] | None = None) -> DataFrame:
    """Rows of a CSV whose lines are quoted as a whole and end in commas: cells
    are split at "," or a bare comma, the header's known misspellings mended."""
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", r'^"|"?,*\s*$', ""), r'"?,"?', "\x01").alias("line"))
    cells = F.split("line", "\x01")
    fixed = {**{c: c for c in columns}, **(misspelt or {})}
    header = [k for k in fixed]
    rows = lines.filter(~F.get(cells, F.lit(0)).isin(header))
    return rows.select(*(F.get(cells, F.lit(i)).alias(fixed.get(c, c)) for i, c in enumerate(columns)))


def folder_census(spark: SparkSession, path: str) -> DataFrame:
    """(folder, kind, files, bytes): what a tree of files holds, by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder, kind = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(folder.alias("folder"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def gtfs_legs(stop_times: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """(u, v, mode, seconds): mean riding time between consecutive stops of the running services."""
    clock = lambda c: F.split(c, ":")
    secs = lambda c: F.get(clock(c), F.lit(0)).cast("int") * 3600 + F.get(clock(c), F.lit(1)).cast("int") * 60 + F.get(clock(c), F.lit(2)).cast("int")
    run = stop_times.join(trips.join(services, "service_id", "left_semi").select("trip_id", "route_id"), "trip_id")
    w = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").cast("int"))
    legs = run.select(
        "trip_id", F.col("stop_id").alias("u"), F.lead("stop_id").over(w).alias("v"), (F.lead(secs("arrival_time")).over(w) - secs("departure_time")).alias("seconds")
    ).filter("v is not null")
    return legs.groupBy("u", "v").agg(F.avg("seconds").alias("seconds")).withColumn("mode", F.lit("transit"))
