"""Shapefiles and well-known binary: a data source that reads ranges of records, and geometry columns."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from geoloom.plans.materialize import ship_package

_PARTS = "array<array<struct<x:double,y:double>>>"
_KINDS = {"C": "string", "L": "boolean", "D": "date", "F": "double", "N": "double", "I": "int"}


class _File:
    """A file of any store that Arrow reaches (a path or an address), read by ranges."""

    def __init__(self, path: str):
        self.store, self.path = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)

    def part(self, at: int, size: int) -> bytes:
        with self.store.open_input_file(self.path) as f:
            return f.read_at(size, at)

    def size(self) -> int:
        return self.store.get_file_info(self.path).size


def table_fields(head: bytes) -> list[tuple[str, str, int, int, int]]:
    """(name, kind, at, size, decimals) of the attribute table's columns, from its head."""
    out, at, k = [], 1, 32
    while k + 32 <= len(head) and head[k] != 0x0D:
        name = head[k : k + 11].split(b"\0")[0].decode("latin-1").strip()
        kind, size, places = chr(head[k + 11]), head[k + 16], head[k + 17]
        out.append((name, kind, at, size, places))
        at, k = at + size, k + 32
    return out


def attribute(raw: bytes, kind: str, places: int, encoding: str):
    """A cell of the attribute table: blank, starred or unreadable cells are null."""
    text = raw.decode(encoding, "replace").strip("\0 ")
    if not text or text[0] == "*":
        return None
    try:
        if kind in "NF":
            return float(text) if places or kind == "F" or not text.lstrip("+-").isdigit() else int(text)
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text[0].upper())
        if kind == "D":
            return dt.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    except ValueError:
        return None
    return text


def shape_parts(content: bytes) -> tuple[int, list | None]:
    """(kind, parts) of a record: 1 points, 3 lines, 5 polygons, 8 groups of points (kinds
    with heights or measures under the plain one's number); null shapes have no parts."""
    kind = struct.unpack_from("<i", content)[0] % 10
    if kind == 1:
        return kind, [[struct.unpack_from("<2d", content, 4)]]
    if kind == 8:
        n = struct.unpack_from("<i", content, 36)[0]
        return kind, [np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2).tolist()]
    if kind in (3, 5):
        parts, n = struct.unpack_from("<2i", content, 36)
        starts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
        points = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
        return kind, [points[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
    return kind, None


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")`` with options ``path`` (of the .shp; .shx and .dbf
    beside it), ``records`` (a partition, 50,000) and ``encoding`` (of text, utf-8)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        head = _File(self._beside("dbf"))
        size = struct.unpack("<H", head.part(8, 2))[0]
        columns = [(n, "bigint" if k == "N" and not p else _KINDS.get(k, "string")) for n, k, _, _, p in table_fields(head.part(0, size))]
        return ", ".join(["record bigint", "shape int", f"parts {_PARTS}", *(f"`{n}` {t}" for n, t in columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShapefileReader(self.options, self._beside, schema)

    def _beside(self, kind: str) -> str:
        return self.options["path"].removesuffix(".shp") + "." + kind


class _ShapefileReader(DataSourceReader):
    def __init__(self, options: dict, beside, schema: StructType):
        self.paths = {k: beside(k) for k in ("shp", "shx", "dbf")}
        self.records, self.encoding, self.kinds = int(options.get("records", 50_000)), options.get("encoding", "utf-8"), schema

    def partitions(self) -> list[_Range]:
        n = (_File(self.paths["shx"]).size() - 100) // 8
        return [_Range(a, min(n, a + self.records)) for a in range(0, n, self.records)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        n, kinds = part.last - part.first, to_arrow_schema(self.kinds)
        if not n:
            return
        index = np.frombuffer(_File(self.paths["shx"]).part(100 + 8 * part.first, 8 * n), ">i4").reshape(n, 2).astype(np.int64) * 2
        begin, end = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
        shapes = _File(self.paths["shp"]).part(begin, end - begin)
        table = _File(self.paths["dbf"])
        skip, width = struct.unpack("<2H", table.part(8, 4))
        fields, rows = table_fields(table.part(0, skip)), table.part(skip + width * part.first, width * n)
        for at in range(0, n, 1_000):
            some = range(at, min(n, at + 1_000))
            found = [shape_parts(shapes[index[i, 0] - begin + 8 : index[i, 0] - begin + 8 + index[i, 1]]) for i in some]
            made = {"record": [part.first + i for i in some], "shape": [k for k, _ in found], "parts": [None if p is None else [[{"x": x, "y": y} for x, y in ring] for ring in p] for _, p in found]}
            for name, kind, start, size, places in fields:
                made[name] = [attribute(rows[width * i + start : width * i + start + size], kind, places, self.encoding) for i in some]
                if kinds.field(name).type == pa.float64():
                    made[name] = [None if v is None else float(v) for v in made[name]]
            yield pa.RecordBatch.from_pydict(made, schema=kinds)


def shapefile(spark: SparkSession, path: str, records: int = 50_000, encoding: str = "utf-8") -> DataFrame:
    """(record, shape, parts, <attributes>) of a shapefile; ``parts`` are a polygon's rings,
    a line's parts or points. Every partition reads its range of ``records`` records
    alone, found by the index file, so a large file is no one task's."""
    ship_package(spark)
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").option("path", path).option("records", records).option("encoding", encoding).load()


def wkb_parts(wkb: Column) -> Column:
    """struct<kind, parts> of a well-known binary column: kind 1 to 6 (point, line, polygon
    and their groups), parts as of :func:`shapefile`; null where it can't be read."""
    kind = _parse_datatype_string(f"kind int, parts {_PARTS}")

    @F.pandas_udf(kind)
    def read(values: pd.Series) -> pd.DataFrame:
        out = [_wkb(v) for v in values]
        return pd.DataFrame({"kind": pd.Series([k for k, _ in out], dtype="Int32"), "parts": [None if p is None else [[{"x": x, "y": y} for x, y in ring] for ring in p] for _, p in out]})

    return read(wkb)


def _wkb(value: bytes | None) -> tuple[int | None, list | None]:
    if value is None:
        return None, None
    try:
        kind, parts, _ = _wkb_at(bytes(value), 0)
        return kind, parts
    except (struct.error, ValueError, IndexError):
        return None, None


def _wkb_at(value: bytes, at: int) -> tuple[int, list, int]:
    order = "<" if value[at] == 1 else ">"
    code = struct.unpack_from(order + "I", value, at + 1)[0]
    at += 5 + (4 if code & 0x20000000 else 0)
    kind = (code & 0xFFFF) % 1000
    more = (code >> 31 & 1) + (code >> 30 & 1) + {0: 0, 1: 1, 2: 1, 3: 2}.get((code & 0xFFFF) // 1000, 0)  # heights, measures

    def points(n: int) -> list:
        nonlocal at
        own = np.frombuffer(value, order + "f8", n * (2 + more), at).reshape(n, 2 + more)[:, :2].tolist()
        at += 8 * n * (2 + more)
        return own

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", value, at - 4)[0]

    if kind == 1:
        return kind, [points(1)], at
    if kind == 2:
        return kind, [points(count())], at
    if kind == 3:
        return kind, [points(count()) for _ in range(count())], at
    if kind in (4, 5, 6, 7):
        parts: list = []
        for _ in range(count()):
            _, own, at = _wkb_at(value, at)
            parts += own
        return kind, parts, at
    raise ValueError(f"no such geometry: {kind}")
