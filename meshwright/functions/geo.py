"""Planar geometry as Column expressions: points are x and y, lines arrays of struct<x,y>, polygons arrays of rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def flat_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between close points by the flat approximation: 111 320 m a degree, less by the cosine of the latitude eastwards."""
    return distance(lon1 * F.cos(F.radians(lat1)) * 111_320, lat1 * 111_320, lon2 * F.cos(F.radians(lat1)) * 111_320, lat2 * 111_320)


def steps(line: Column | str) -> Column:
    """Pairs of neighbouring vertices."""
    n = F.size(line)
    return F.arrays_zip(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def line_length(line: Column) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring (first vertex repeated at the end), negative if it runs clockwise."""
    return F.aggregate(steps(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2


def ring_area(ring: Column) -> Column:
    """Area of a closed ring, without sign."""
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid of a closed ring as struct<x,y>; the first vertex of one without area."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, p: F.struct((s["a"] + cross(p)).alias("a"), (s["x"] + (p["a"]["x"] + p["b"]["x"]) * cross(p)).alias("x"), (s["y"] + (p["a"]["y"] + p["b"]["y"]) * cross(p)).alias("y"))
    done = lambda s: F.when(s["a"] == 0, ring[0]).otherwise(F.struct(F.try_divide(s["x"], 3 * s["a"]).alias("x"), F.try_divide(s["y"], 3 * s["a"]).alias("y")))
    return F.aggregate(steps(ring), zero, add, done)


def middle_vertex(line: Column) -> Column:
    """A point of the line itself that stands for it."""
    return F.element_at(line, (F.floor(F.size(line) / 2) + 1).cast("int"))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ray to the right crosses the closed ring an odd number of times."""
    def crosses(p):
        ax, ay, bx, by = p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]
        return F.when(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax), 1).otherwise(0)

    return F.aggregate(steps(ring), F.lit(0), lambda s, p: s + crosses(p)) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies on an edge of the ring."""
    def on(p):
        ax, ay, bx, by = p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]
        straight = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
        return straight & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(steps(ring), on)


def inside_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Within the outer ring and outside all holes, edges excluded: an odd number of rings hold the point."""
    odd = F.aggregate(rings, F.lit(0), lambda s, r: s + inside_ring(x, y, r).cast("int")) % 2 == 1
    return odd & ~F.exists(rings, lambda r: on_ring(x, y, r))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long == 0, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.when(long == 0, F.lit(1.0)).otherwise(long))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, ax + t * dx, ay + t * dy)


def cells_of(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """The grid cells that a segment passes, as array<struct<cx,cy>>: those on both sides of each grid line that it crosses, and those of its ends.

    As many as it crosses lines, however slanted it is; where it crosses near a corner a cell beside it may be among them.
    """
    cell = lambda v: F.floor(v / size)
    none = F.array().cast("array<struct<cx:bigint,cy:bigint>>")

    def crossed(a: Column, b: Column, c: Column, d: Column, swap: bool) -> Column:
        def beside(k: Column) -> Column:
            other = cell(c + (d - c) * (k * F.lit(float(size)) - a) / (b - a))
            pair = lambda i: F.struct(other.alias("cx"), i.alias("cy")) if swap else F.struct(i.alias("cx"), other.alias("cy"))
            return F.array(pair(k), pair(k - 1))

        first, last = cell(F.least(a, b)) + 1, cell(F.greatest(a, b))
        return F.when(first <= last, F.flatten(F.transform(F.sequence(first, F.greatest(first, last)), beside))).otherwise(none)

    ends = F.array(*(F.struct(cell(x).alias("cx"), cell(y).alias("cy")) for x, y in ((ax, ay), (bx, by))))
    return F.array_distinct(F.concat(ends, crossed(ax, bx, ay, by, False), crossed(ay, by, ax, bx, True)))


#: Parts of a segment's length within which two points of it are one.
NEAR = 1e-9


def meeting(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Where a segment a-b meets a segment c-d, as parts of the way from a to b; two places where they lie on one line. Near misses at ends count."""
    rx, ry, sx, sy, qx, qy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    across, aside, long = rx * sy - ry * sx, qx * ry - qy * rx, rx * rx + ry * ry
    t, u = F.try_divide(qx * sy - qy * sx, across), F.try_divide(aside, across)
    none = F.array().cast("array<double>")
    along = lambda x, y: (x * rx + y * ry) / long
    level = F.when(F.abs(aside) <= NEAR * long, F.array(along(qx, qy), along(dx - ax, dy - ay))).otherwise(none)
    hit = F.when(t.between(-NEAR, 1 + NEAR) & u.between(-NEAR, 1 + NEAR), F.array(t)).otherwise(none)
    return F.when(F.abs(across) <= NEAR * NEAR * long, level).otherwise(hit)


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def project_utm(df: DataFrame, lon: str, lat: str, zone: int = 19, south: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """WGS 84 degrees to UTM metres by Krueger's series to the third order, in staged columns so that plans stay small."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    central = math.radians(6 * zone - 183)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    out = df.withColumn("_s", F.sin(F.radians(F.col(lat)))).withColumn("_dl", F.radians(F.col(lon)) - central)
    out = out.withColumn("_t", F.sinh(atanh(F.col("_s")) - e * atanh(e * F.col("_s"))))
    out = out.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_dl"))).withColumn("_eta", atanh(F.sin("_dl") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    east, north = F.col("_eta"), F.col("_xi")
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
        north = north + c * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
    out = out.withColumn(x, 500_000 + 0.9996 * big_a * east).withColumn(y, (10_000_000 if south else 0) + 0.9996 * big_a * north)
    return out.drop("_s", "_dl", "_t", "_xi", "_eta")


def unproject_utm(df: DataFrame, x: str, y: str, zone: int = 19, south: bool = True, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """UTM metres back to WGS 84 degrees: the inverse series to the fourth order, and the latitude by three of Newton's steps."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    out = df.withColumn("_n", (F.col(y) - (10_000_000 if south else 0)) / (0.9996 * big_a)).withColumn("_e", (F.col(x) - 500_000) / (0.9996 * big_a))
    xi, eta = F.col("_n"), F.col("_e")
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * F.col("_n")) * F.cosh(2 * j * F.col("_e"))
        eta = eta - c * F.cos(2 * j * F.col("_n")) * F.sinh(2 * j * F.col("_e"))
    out = out.withColumn("_xi", xi).withColumn("_eta", eta)
    # the tangent of the conformal latitude, and from it that of the latitude
    sinh, cos = F.sinh("_eta"), F.cos("_xi")
    out = out.withColumn("_c", F.sin("_xi") / F.sqrt(sinh * sinh + cos * cos)).withColumn("_dl", F.atan2(sinh, cos)).withColumn("_t", F.col("_c"))
    for _ in range(3):
        t, c = F.col("_t"), F.col("_c")
        out = out.withColumn("_r", F.sqrt(1 + t * t)).withColumn("_s", F.sinh(e * atanh(e * t / F.col("_r"))))
        made = t * F.sqrt(1 + F.col("_s") * F.col("_s")) - F.col("_s") * F.col("_r")
        step = (c - made) / F.sqrt(1 + made * made) * (1 + (1 - e2) * t * t) / ((1 - e2) * F.col("_r"))
        out = out.withColumn("_t", t + step)
    central = 6 * zone - 183
    out = out.withColumn(lon, F.degrees("_dl") + central).withColumn(lat, F.degrees(F.atan("_t")))
    return out.drop("_n", "_e", "_xi", "_eta", "_c", "_dl", "_t", "_r", "_s")
