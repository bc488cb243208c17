import json
import math
import random
import statistics
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.operators import aggregates
from meshwright.sources import wkb


def v(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE, HOLE = v((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), v((1, 1), (1, 2), (2, 2), (1, 1))
SHAPES = [
    None, {"kind": "Point", "parts": [[v((1.5, -2))]]}, {"kind": "Point", "parts": []}, {"kind": "LineString", "parts": [[v((0, 0), (1, 1), (2, 0))]]},
    {"kind": "LineString", "parts": []}, {"kind": "Polygon", "parts": [[SQUARE, HOLE]]}, {"kind": "Polygon", "parts": []},
    {"kind": "MultiPoint", "parts": [[v((1, 2))], [v((3, 4))]]}, {"kind": "MultiLineString", "parts": [[v((0, 0), (1, 1))], [v((5, 5), (6, 6), (7, 5))]]},
    {"kind": "MultiPolygon", "parts": [[SQUARE, HOLE], [v((20, 20), (30, 20), (20, 30), (20, 20))]]}, {"kind": "MultiPolygon", "parts": []},
]


def test_values_as_the_format_says():
    """Bytes written by hand: both byte orders, heights, measures and a reference system's number."""
    assert wkb.encode(SHAPES[1]) == bytes.fromhex("0101000000") + struct.pack("<2d", 1.5, -2)
    line = bytes([0]) + struct.pack(">II4d", 2, 2, 1, 2, 3, 4)
    assert wkb.decode(line) == {"kind": "LineString", "parts": [[v((1, 2), (3, 4))]]}
    for code, wide in ((1001, 3), (2001, 3), (3001, 4), (0x80000001, 3), (0x40000001, 3), (0xC0000001, 4)):
        assert wkb.decode(struct.pack("<BI", 1, code) + struct.pack(f"<{wide}d", 7, 8, *range(wide - 2))) == {"kind": "Point", "parts": [[v((7, 8))]]}
    assert wkb.decode(struct.pack("<BII2d", 1, 0x20000001, 4326, 7, 8)) == {"kind": "Point", "parts": [[v((7, 8))]]}
    mixed = struct.pack("<BII", 1, 4, 2) + struct.pack(">BI2d", 0, 1, 1, 2) + struct.pack("<BI2d", 1, 1, 3, 4)
    assert wkb.decode(mixed) == SHAPES[7]
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BII", 1, 7, 0))
    assert [wkb.decode(wkb.encode(s)) for s in SHAPES] == SHAPES


def test_layers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)], f"id int, geometry {wkb.GEOMETRY.simpleString()}").repartition(3)
    wkb.write_geo(rows, str(tmp_path / "l"))
    back = {r.id: r.geometry.asDict(True) if r.geometry else None for r in wkb.read_geo(spark, str(tmp_path / "l")).collect()}
    assert back == dict(enumerate(SHAPES))
    told = wkb.footer(spark, str(tmp_path / "l"))
    assert told["primary_column"] == "geometry" and told["columns"]["geometry"]["geometry_types"] == sorted(wkb.KINDS)
    near = wkb.read_geo(spark, str(tmp_path / "l"), ["id"], (4.5, 4.5, 5.5, 5.5))
    assert sorted(r.id for r in near.collect()) == [5, 8, 9] and near.columns == ["id", "geometry"]
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = near._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(bbox.xmax,4.5)" in plan


def test_layers_that_other_tools_wrote(spark, tmp_path):
    """A file with its own key in the footer and no bounds, as the format's writers leave it."""
    told = {"version": "1.0.0", "primary_column": "shape", "columns": {"shape": {"encoding": "WKB", "geometry_types": []}}}
    table = pa.table({"id": list(range(len(SHAPES))), "shape": pa.array(map(wkb.encode, SHAPES), pa.binary())}).replace_schema_metadata({"geo": json.dumps(told)})
    pq.write_table(table, tmp_path / "x.parquet")
    assert wkb.footer(spark, str(tmp_path / "x.parquet")) == told
    back = wkb.read_geo(spark, str(tmp_path / "x.parquet"))
    assert {r.id: r["shape"].asDict(True) if r["shape"] else None for r in back.collect()} == dict(enumerate(SHAPES))
    assert sorted(r.id for r in wkb.read_geo(spark, str(tmp_path / "x.parquet"), ["id"], (4.5, 4.5, 5.5, 5.5)).collect()) == [5, 8, 9]


def test_shapes_of_layers_as_geometries(spark):
    rows = spark.createDataFrame([(SQUARE, None)], "line array<struct<x:double,y:double>>, none array<struct<x:double,y:double>>")
    made = rows.select(
        wkb.geometry("LineString", F.col("line")).alias("a"), wkb.geometry("Polygon", F.array("line")).alias("b"), wkb.geometry("Point", F.col("line")[1]).alias("c"),
        wkb.geometry("MultiLineString", F.array("line", "line")).alias("d"), wkb.geometry("MultiPoint", F.slice("line", 1, 2)).alias("e"), wkb.geometry("LineString", F.col("none")).alias("f"),
    ).first()
    parts = [made[c].asDict(True)["parts"] if made[c] else None for c in "abcdef"]
    assert parts == [[[SQUARE]], [[SQUARE]], [[[SQUARE[1]]]], [[SQUARE], [SQUARE]], [[[SQUARE[0]]], [[SQUARE[1]]]], None]


def test_degrees_there_and_back(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-72.5, -65.5), rng.uniform(-79, -0.5)) for _ in range(500)]
    there = geo.project_utm(spark.createDataFrame(rows, "lon0 double, lat0 double"), "lon0", "lat0")
    for r in geo.unproject_utm(there, "x", "y").collect():
        assert abs(r.lon - r.lon0) < 1e-9 and abs(r.lat - r.lat0) < 1e-9
    north = geo.unproject_utm(geo.project_utm(spark.createDataFrame([(9.0, 48.0)], "a double, b double"), "a", "b", 32, False), "x", "y", 32, False).first()
    assert (round(north.lon, 9), round(north.lat, 9), round(north.x, 3)) == (9.0, 48.0, 500_000.0)


@pytest.mark.parametrize("few", [4096, 3])
def test_medians_by_counts(spark, monkeypatch, few):
    """Many ties, values far apart, one value, both parities, nulls and NaN; as statistics.median has it."""
    monkeypatch.setattr(aggregates, "FEW", few)
    rng = random.Random(4)
    cases = [
        [rng.gauss(0, 1) for _ in range(1001)], [rng.gauss(0, 1) for _ in range(1000)], [rng.randint(0, 3) * 1.0 for _ in range(900)], [7.0] * 50, [1.0, 2.0], [5.0],
        [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(501)], [1e308, -1e308, 1.0, 2.0] * 3, [0.0] * 400 + [1e300] * 401, [0.1 + k * 1e-17 for k in range(60)] + [1e9],
    ]
    for values in cases:
        rows = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "v double").repartition(3)
        assert aggregates.median(rows, "v") == statistics.median(values)
    assert aggregates.median(spark.createDataFrame([(None,)], "v double"), "v") is None
