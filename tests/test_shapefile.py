"""Shapefiles written here byte by byte, and well-known binary."""

from __future__ import annotations

import datetime as dt
import random
import struct


def write(path, shapes, fields, rows):
    """shapes: (kind, parts); fields: (name, kind, size, places)."""
    body, index, at = b"", b"", 50
    for i, (kind, parts) in enumerate(shapes, 1):
        if kind == 0:
            own = struct.pack("<i", 0)
        elif kind == 1:
            own = struct.pack("<i2d", 1, *parts[0][0])
        else:
            points = [p for part in parts for p in part]
            xs, ys = zip(*points)
            starts, n = [], 0
            for part in parts:
                starts.append(n)
                n += len(part)
            own = struct.pack("<i4d", kind, min(xs), min(ys), max(xs), max(ys))
            own += struct.pack("<i", n) if kind == 8 else struct.pack(f"<2i{len(starts)}i", len(starts), n, *starts)
            own += b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(own) // 2) + own
        index += struct.pack(">2i", at, len(own) // 2)
        at += 4 + len(own) // 2
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    open(f"{path}.shp", "wb").write(head(100 + len(body)) + body)
    open(f"{path}.shx", "wb").write(head(100 + len(index)) + index)
    width = 1 + sum(s for _, _, s, _ in fields)
    out = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for name, kind, size, places in fields:
        out += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, places]) + b"\0" * 14
    out += b"\x0d"
    for row in rows:
        out += b" " + b"".join(v.encode().ljust(s)[:s] for v, (_, _, s, _) in zip(row, fields))
    open(f"{path}.dbf", "wb").write(out + b"\x1a")


FIELDS = [("name", "C", 12, 0), ("people", "N", 9, 0), ("share", "N", 9, 3), ("open", "L", 1, 0), ("built", "D", 8, 0)]


def test_ranges_of_records(spark, tmp_path):
    from geoloom.sources.shapefile import shapefile

    rng = random.Random(1)
    ring = lambda: [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(3, 8))]
    shapes = [(5, [ring() for _ in range(rng.randint(1, 3))]) for _ in range(23)] + [(0, None), (1, [[(1.5, -2.0)]]), (3, [ring(), ring()]), (8, [ring()])]
    rows = [(f"né {i}", str(i * 7), f"{i / 8:.3f}", "TFYN"[i % 4], f"202401{i % 28 + 1:02d}") for i in range(25)] + [("", "***", "", "?", "")] * 2
    write(tmp_path / "zones", shapes, FIELDS, rows)
    df = shapefile(spark, str(tmp_path / "zones.shp"), records=5)
    assert df.rdd.getNumPartitions() == 6
    got = sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["record"])
    assert [r["record"] for r in got] == list(range(27)) and [r["shape"] for r in got] == [k for k, _ in shapes]
    for r, (_, parts) in zip(got, shapes):
        assert (None if r["parts"] is None else [[(p["x"], p["y"]) for p in part] for part in r["parts"]]) == parts
    for i, r in enumerate(got[:25]):
        assert (r["name"], r["people"], r["share"], r["open"], r["built"]) == (f"né {i}", i * 7, i / 8, i % 4 in (0, 2), dt.date(2024, 1, i % 28 + 1))
    assert [got[25][c] for c in ("name", "people", "share", "open", "built")] == [None] * 5


def test_polygons_go_on_to_the_joins(spark, tmp_path):
    from geoloom.operators.polygons import points_in_polygons
    from geoloom.sources.shapefile import shapefile

    write(tmp_path / "two", [(5, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]])], FIELDS[:1], [("a",)])
    zones = shapefile(spark, str(tmp_path / "two.shp")).selectExpr("name as poly_id", "parts as rings")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0)], "id int, x double, y double")
    assert [tuple(r) for r in points_in_polygons(points, zones, 1.0).select("id", "poly_id").collect()] == [(1, "a")]


def test_an_empty_file(spark, tmp_path):
    from geoloom.sources.shapefile import shapefile

    write(tmp_path / "none", [], FIELDS, [])
    assert shapefile(spark, str(tmp_path / "none.shp")).collect() == []


def test_well_known_binary(spark):
    from pyspark.sql import functions as F

    from geoloom.sources.shapefile import wkb_parts

    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    polygon = struct.pack(">BIII6d", 0, 3, 1, 3, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    values = [struct.pack("<BI2d", 1, 1, 5.0, 6.0), line, polygon, struct.pack("<BII", 1, 5, 2) + line + line, struct.pack("<BII3d", 1, 1 | 0x20000000 | 0x80000000, 4326, 1.0, 2.0, 9.0), struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 9.0), b"\x01\x02", b"", None]
    got = spark.createDataFrame([(v,) for v in values], "w binary").select(wkb_parts(F.col("w")).alias("g")).select("g.*").collect()
    plain = [(r["kind"], None if r["parts"] is None else [[(p["x"], p["y"]) for p in part] for part in r["parts"]]) for r in got]
    path = [(0.0, 1.0), (2.0, 3.0)]
    assert plain == [(1, [[(5.0, 6.0)]]), (2, [path]), (3, [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]), (5, [path, path]), (1, [[(1.0, 2.0)]]), (1, [[(1.0, 2.0)]]), (None, None), (None, None), (None, None)]
