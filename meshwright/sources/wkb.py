"""Layers with geometries in well-known binary, as geo-Parquet holds them.

A geometry is struct<kind:string, parts:array<array<array<struct<x,y>>>>>: parts, of each its rings (a point's or line's only one), of each its vertices. So one
shape serves points, lines, areas and several of them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The format's numbers for kinds.
KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
_NAMES = {n: k for k, n in KINDS.items()}
GEOMETRY = (
    T.StructType()
    .add("kind", T.StringType())
    .add("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())))))
)
_BOUNDS = ("xmin", "ymin", "xmax", "ymax")
#: The key of geo-Parquet in a file's footer and, where Spark writes the file, in the column's metadata there.
GEO = "geo"


def _vertices(ring: list[dict]) -> bytes:
    return np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes()


def encode(geometry: dict | None) -> bytes | None:
    """Well-known binary, little-endian, of one geometry; null of null. A point without parts is the empty point, of two NaN."""
    if geometry is None:
        return None
    kind, parts = geometry["kind"], geometry["parts"] or []
    head = struct.pack("<BI", 1, KINDS[kind])
    if kind == "Point":
        return head + (_vertices(parts[0][0]) if parts and parts[0] and parts[0][0] else struct.pack("<2d", np.nan, np.nan))
    if kind == "LineString":
        line = parts[0][0] if parts and parts[0] else []
        return head + struct.pack("<I", len(line)) + _vertices(line)
    if kind == "Polygon":
        rings = parts[0] if parts else []
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + _vertices(r) for r in rings)
    single = kind.removeprefix("Multi")
    return head + struct.pack("<I", len(parts)) + b"".join(encode({"kind": single, "parts": [p]}) for p in parts)


class _Reader:
    """One value, read from its start; coordinates beyond x and y (heights, measures) are passed over."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(order + "I", self.data, self.at - 4)[0]

    def vertices(self, order: str, n: int, wide: int) -> list[dict]:
        found = np.frombuffer(self.data, order + "f8", n * wide, self.at).reshape(n, wide)
        self.at += 8 * n * wide
        return [{"x": float(x), "y": float(y)} for x, y in found[:, :2]]

    def geometry(self) -> dict:
        order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.number(order)
        high, code = code >> 28, code & 0x0FFFFFFF
        wide = 2 + (high >> 3 & 1) + (high >> 2 & 1) + (0, 1, 1, 2)[code // 1000]
        if high & 2:  # a reference system's number
            self.number(order)
        kind = _NAMES.get(code % 1000)
        if kind is None:
            raise ValueError(f"geometries of kind {code % 1000} aren't read")
        if kind == "Point":
            vertex = self.vertices(order, 1, wide)
            return {"kind": kind, "parts": [] if np.isnan(vertex[0]["x"]) and np.isnan(vertex[0]["y"]) else [[vertex]]}
        n = self.number(order)
        if kind == "LineString":
            line = self.vertices(order, n, wide)
            return {"kind": kind, "parts": [[line]] if line else []}
        if kind == "Polygon":
            rings = [self.vertices(order, self.number(order), wide) for _ in range(n)]
            return {"kind": kind, "parts": [rings] if rings else []}
        return {"kind": kind, "parts": [part for _ in range(n) for part in self.geometry()["parts"]]}


def decode(data: bytes | None) -> dict | None:
    """The geometry of a value in well-known binary, of either byte order; null of null."""
    return None if data is None else _Reader(data).geometry()


@F.arrow_udf(T.BinaryType())
def _encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for geometries in batches:
        yield pa.array(map(encode, geometries.to_pylist()), pa.binary())


_ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])


@F.arrow_udf(GEOMETRY)
def _decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield pa.array(map(decode, values.to_pylist()), _ARROW)


def to_wkb(geometry: Column | str) -> Column:
    return _encoded(geometry)


def from_wkb(value: Column | str) -> Column:
    return _decoded(value)


def geometry(kind: str, value: Column) -> Column:
    """A point (struct<x,y>), line (array of them), area (array of rings), or an array of one of these, as a geometry; null of null."""
    depth = {"Point": 3, "LineString": 2, "Polygon": 1}[kind.removeprefix("Multi")]
    wrap = lambda v, n: v if n == 0 else wrap(F.array(v), n - 1)
    parts = F.transform(value, lambda v: wrap(v, depth - 1)) if kind.startswith("Multi") else wrap(value, depth)
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(GEOMETRY))


def line_parts(column: str = "geometry") -> Column:
    """All lines of a geometry, one or several, as array<array<struct<x,y>>>."""
    return F.transform(F.col(column)["parts"], lambda part: part[0])


def bounds(column: str = "geometry") -> Column:
    """struct<xmin,ymin,xmax,ymax> of a geometry; null where there is no vertex."""
    vertex = F.flatten(F.flatten(F.col(column)["parts"]))
    of = lambda v: F.transform(vertex, lambda p: p[v])
    each = (F.array_min(of("x")), F.array_min(of("y")), F.array_max(of("x")), F.array_max(of("y")))
    return F.when(F.size(vertex) > 0, F.struct(*(c.alias(name) for c, name in zip(each, _BOUNDS))))


def write_geo(df: DataFrame, path: str, column: str = "geometry", crs: str = "EPSG:4326") -> None:
    """df as Parquet with its geometry in well-known binary and its bounds as a column `bbox`, by whose statistics ranges are passed over.

    What geo-Parquet keeps in a footer of its own key (columns, encoding, kinds, covering) goes where Spark lets a writer put it: into the
    column's metadata, which is in each file's footer.
    """
    kinds = sorted(r.kind for r in df.select(F.col(column)["kind"].alias("kind")).distinct().filter("kind is not null").collect())  # six at most
    covering = {"bbox": {name: ["bbox", name] for name in _BOUNDS}}
    told = {"version": "1.1.0", "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": kinds, "crs": crs, "covering": covering}}}
    rows = df.withColumn("bbox", bounds(column)).withColumn(column, to_wkb(column))
    rows.withMetadata(column, {GEO: json.dumps(told)}).write.parquet(path)


def footer(spark: SparkSession, path: str) -> dict:
    """The geo metadata of a layer: of the first file's footer, by the format's own key, else of the column's metadata; empty where there are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return {}
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        told = reader.getFileMetaData().getKeyValueMetaData().get(GEO)
    finally:
        reader.close()
    if told is None:
        told = next((f.metadata[GEO] for f in spark.read.parquet(path).schema if GEO in f.metadata), None)
    return json.loads(told) if told else {}


def read_geo(spark: SparkSession, path: str, columns: list[str] | None = None, box: tuple[float, float, float, float] | None = None, column: str | None = None) -> DataFrame:
    """A layer's columns with its geometry decoded, of rows whose bounds touch `box` (xmin, ymin, xmax, ymax).

    The geometry's column is the one that the footer names, else `column` or geometry. Bounds are compared before geometries are decoded: where the file
    has them as bbox, in the scan, else as they are decoded.
    """
    told = footer(spark, path)
    column = column or told.get("primary_column", "geometry")
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c != "bbox"] if columns is None else [*columns, *([column] if column not in columns else [])]
    near = lambda b: (b["xmax"] >= box[0]) & (b["ymax"] >= box[1]) & (b["xmin"] <= box[2]) & (b["ymin"] <= box[3])
    listed = "bbox" in rows.columns
    if box and listed:
        rows = rows.filter(near(F.col("bbox")))
    rows = rows.select(*(F.col(f"`{c}`") for c in own)).withColumn(column, from_wkb(column))
    return rows.filter(near(bounds(column))) if box and not listed else rows
