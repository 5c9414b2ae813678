"""Sinks: graphs, matrices and features as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two parquet tables under a folder."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def wide_matrix(od: DataFrame, destinations: list, value: str = "cost") -> DataFrame:
    """One row an origin, one column a destination: for export only, the list of destinations bounds its width."""
    return od.groupBy("o").pivot("d", destinations).agg(F.first(value))


def as_geojson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(feature): a GeoJSON Feature of each row's point, the other columns its properties."""
    rest = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), point.alias("geometry"))).alias("feature"))
