import math
import random

import pytest
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.operators import areas

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, x, y, far, n, whole=True):
    """A ring around a place, often with vertices on grid lines and corners."""
    out = []
    for i in range(n):
        r, a = far * rng.uniform(0.3, 1), 2 * math.pi * (i + rng.uniform(0, 0.9)) / n
        at = (x + r * math.cos(a), y + r * math.sin(a))
        out.append(tuple(round(v / 5) * 5 for v in at) if whole else at)
    return ring(out)


def inside(x, y, rings):
    odd = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
    return odd


def far_from_edges(x, y, rings):
    def distance(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = max(0, min(1, ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return min(distance(a, b) for r in rings for a, b in zip(r, r[1:]))


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(5)
    out = [(k, [star(rng, rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([8, 60, 250]), rng.randint(3, 30), k % 3 > 0)]) for k in range(20)]
    out += [(100, [ring([(0, 0), (320, 0), (320, 320), (0, 320)]), ring([(50, 50), (50, 100), (100, 100), (100, 50)])])]
    return out


@pytest.mark.parametrize("size", [10.0, 37.0, 2000.0])
def test_points_meet_cells_and_not_rings(spark, shapes, size):
    """The same polygons as rays through whole rings find; points on corners, lines and edges of the grid and of polygons."""
    rng = random.Random(6)
    points = [(i, rng.uniform(-50, 350), rng.uniform(-50, 350)) for i in range(1500)] + [(2000 + i, rng.randint(-5, 35) * 10.0, rng.randint(-5, 35) * 10.0) for i in range(500)]
    polygons = spark.createDataFrame(shapes, f"polygon_id int, rings {RINGS}").repartition(3)
    cells = areas.cover(polygons, size)
    got = {(r.id, r.polygon_id) for r in areas.holders(spark.createDataFrame(points, "id int, x double, y double"), cells, size).collect()}
    want = {(i, k) for i, x, y in points for k, rings in shapes if inside(x, y, rings) and far_from_edges(x, y, rings) > 1e-9 * size}
    assert got == want
    near = {(r.id, r.polygon_id) for r in areas.holders(spark.createDataFrame(points, "id int, x double, y double"), cells, size, edges=True).collect()}
    assert near == want | {(i, k) for i, x, y in points for k, rings in shapes if far_from_edges(x, y, rings) <= 1e-9 * size}
    if size == 10.0:  # inner cells are large and hold no edges
        inner = cells.filter("edges is null and polygon_id = 100")
        assert inner.agg(F.max("level")).first()[0] >= 3 and inner.count() < 200
        assert cells.filter("edges is not null and polygon_id = 100").select(F.max(F.size("edges"))).first()[0] <= 2


def test_nothing_to_hold(spark):
    none = spark.createDataFrame([], f"polygon_id int, rings {RINGS}")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert [tuple(r) for r in areas.within_join(points, none, 5.0).collect()] == [(1, None)]
    empty = spark.createDataFrame([(1, [])], f"polygon_id int, rings {RINGS}")
    assert areas.within_join(points, empty, 5.0).first().polygon_id is None
    assert areas.dissolve(none.withColumn("k", F.lit("x")), "k").count() == 0


def test_long_segments_lie_in_few_cells(spark):
    """A diagonal of 10 km lies in hundreds of cells of 40 m; every point of a segment lies in one of its cells."""
    rng = random.Random(8)
    rows = [(0, 3.0, 5.0, 7074.0, 7076.0)] + [(i, *(rng.choice([rng.uniform(-200, 200), rng.randint(-5, 5) * 40.0]) for _ in range(4))) for i in range(1, 300)]
    found = spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by double")
    found = {r.id: {tuple(c) for c in r.c} for r in found.select("id", geo.cells_of(*map(F.col, ("ax", "ay", "bx", "by")), 40.0).alias("c")).collect()}
    assert 250 < len(found[0]) < 1100
    for i, ax, ay, bx, by in rows:
        for k in range(201):
            x, y = ax + k / 200 * (bx - ax), ay + k / 200 * (by - ay)
            assert (math.floor(x / 40), math.floor(y / 40)) in found[i]


def length(points):
    return sum(math.dist(a, b) for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("size", [15.0, 120.0])
def test_lines_clipped_by_areas(spark, size):
    """Against sampling each line finely; two polygons that share an edge are one area."""
    rng = random.Random(9)
    shapes = [(1, [ring([(0, 0), (100, 0), (100, 100), (0, 100)]), ring([(20, 20), (20, 40), (40, 40), (40, 20)])]), (2, [ring([(100, 0), (200, 50), (100, 100)])]), (3, [star(rng, 300, 60, 70, 9, False)])]
    lines = [(i, [{"x": rng.uniform(-40, 400), "y": rng.uniform(-40, 140)} for _ in range(rng.randint(2, 5))], "tag") for i in range(60)]
    lines += [(100, ring([(-10, 50), (150, 50)])[:2], "t"), (101, ring([(0, 0), (100, 0)])[:2], "t"), (102, ring([(-5, 100), (50, 100), (50, 120)])[:3], "t"), (103, ring([(10, 10)])[:1], "t"), (104, ring([(-10, -10), (0, 0)])[:2], "t")]
    got = {}
    for r in areas.clip_lines(spark.createDataFrame(lines, f"way_id int, line array<struct<x:double,y:double>>, tag string"), spark.createDataFrame(shapes, f"polygon_id int, rings {RINGS}"), size).collect():
        assert r.tag in ("tag", "t")
        got.setdefault(r.way_id, []).append([(p.x, p.y) for p in r.line])
    for i, line, _ in lines[:60]:
        fine, total = 4000, 0.0
        for a, b in zip(line, line[1:]):
            hits = sum(any(inside(a["x"] + (k + 0.5) / fine * (b["x"] - a["x"]), a["y"] + (k + 0.5) / fine * (b["y"] - a["y"]), s) for _, s in shapes) for k in range(fine))
            total += hits / fine * math.dist((a["x"], a["y"]), (b["x"], b["y"]))
        assert sum(map(length, got.get(i, []))) == pytest.approx(total, abs=1.0)
    assert got[100] == [[(0.0, 50.0), (150.0, 50.0)]]  # over the shared edge at x = 100, without a vertex there
    assert got[101] == [[(0.0, 0.0), (100.0, 0.0)]] and got[102] == [[(0.0, 100.0), (50.0, 100.0)]]
    assert 103 not in got and 104 not in got


def test_rings_cut_by_a_box(spark):
    rng = random.Random(10)
    shapes = [(k, [star(rng, rng.uniform(-20, 120), rng.uniform(-20, 120), 60, 12, False)]) for k in range(30)] + [(50, [ring([(200, 200), (210, 200), (200, 210)])]), (51, [ring([(-50, -50), (200, -50), (200, 200), (-50, 200)])])]
    polygons = spark.createDataFrame(shapes, f"polygon_id int, rings {RINGS}")
    kept = areas.clip_rings(polygons, 0, 0, 100, 100)
    got = {r.polygon_id: r.area for r in kept.select("polygon_id", geo.ring_area(F.get("rings", F.lit(0))).alias("area")).collect()}
    assert 50 not in got and got[51] == 10_000
    for k, rings in shapes[:30]:
        n = 200
        area = sum(inside((i + 0.5) * 100 / n, (j + 0.5) * 100 / n, rings) for i in range(n) for j in range(n)) * (100 / n) ** 2
        assert got.get(k, 0.0) == pytest.approx(area, abs=60)
    points = [p for r in kept.collect() for one in r.rings for p in one]
    assert all(-1e-9 <= v <= 100 + 1e-9 for p in points for v in p)


def test_unions_of_a_mesh(spark):
    """Squares of random names: areas, outlines and rings as a flood fill counts them, also where squares touch in corners."""
    rng, n = random.Random(11), 12
    name = {(x, y): rng.choice("abc") for x in range(n) for y in range(n)}
    square = lambda x, y: ring([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])
    rows = [(i, v, [list(reversed(square(*k))) if i % 2 else square(*k)]) for i, (k, v) in enumerate(name.items())] + [(999, name[0, 0], [square(0, 0)])]
    found = areas.dissolve(spark.createDataFrame(rows, f"polygon_id int, k string, rings {RINGS}"), "k").collect()
    for r in found:
        cells = {c for c, v in name.items() if v == r.k}
        sides = {(c, d) for c in cells for d in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (c[0] + d[0], c[1] + d[1]) not in cells}
        assert r.area == len(cells) and sum(length([tuple(p) for p in one]) for one in r.rings) == len(sides)
        # from a side to the next one along the same cells
        def ahead(c, d):
            left = (-d[1], d[0])
            over, slant = (c[0] + left[0], c[1] + left[1]), (c[0] + left[0] + d[0], c[1] + left[1] + d[1])
            if over not in cells:
                return c, left
            return (over, d) if slant not in cells else (slant, (-left[0], -left[1]))

        rings, left = 0, set(sides)
        while left:
            at = start = next(iter(left))
            rings += 1
            while True:
                left.discard(at)
                at = ahead(*at)
                if at == start:
                    break
        assert len(r.rings) == rings
        for x in range(n):
            for y in range(n):
                assert inside(x + 0.5, y + 0.5, [[p.asDict() for p in one] for one in r.rings]) == ((x, y) in cells)
