"""Planar spatial joins without an index: rows meet in grid cells by equal keys, then the exact predicate decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.operators.components import connected_components
from meshwright.plans.materialise import checkpoint, dealt


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Each row in its cell and the eight around it."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_cx", F.explode(F.transform(near, lambda d: d + _cell(F.col(x), size)))).withColumn("_cy", F.explode(F.transform(near, lambda d: d + _cell(F.col(y), size))))


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left(id, x, y) and right(id, x, y) at most `radius` apart: left_id, right_id, distance."""
    a = _around(left.select(F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay")), "ax", "ay", radius)
    b = right.select(F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), _cell(F.col("x"), radius).alias("_cx"), _cell(F.col("y"), radius).alias("_cy"))
    d = geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(dealt(b), ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).select("left_id", "right_id", "distance")


#: A coarser grid's cells have this many times the side of the next finer one's.
COARSER = 4
#: Occupied cells of one grid that are sent whole to all executors.
SENT = 1 << 14


def nearest_join(left: DataFrame, right: DataFrame, first: float, most: float | None = None) -> DataFrame:
    """The nearest right point of each left point (at most `most` away): left_id, right_id, distance; ties to the lower right_id.

    One radius join finds those within `first`. The other points go down grids of occupied cells, each COARSER times as fine as the one
    before, from one that holds everything: at each, a cell stays if its nearest edge is no farther than the farthest
    corner of some other cell. So a far point meets the points of a few small cells, however many there are in all.
    """
    left = checkpoint(left.select("id", "x", "y"))
    right = checkpoint(right.select("id", "x", "y"))
    radius = first if most is None else min(first, most)
    found = checkpoint(_nearest(radius_join(left, right, radius)))
    if most is not None and most <= first:
        return found
    open_ = checkpoint(left.join(found.select(F.col("left_id").alias("id")), "id", "left_anti"))
    if open_.isEmpty():
        return found
    return found.unionByName(_nearest(_descended(open_, right, first, most)))


def _nearest(pairs: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("right_id", "distance"), F.struct("distance", "right_id")).alias("b")
    return pairs.groupBy("left_id").agg(best).select("left_id", "b.right_id", "b.distance")


def _descended(left: DataFrame, right: DataFrame, size: float, most: float | None) -> DataFrame:
    """Pairs (left_id, right_id, distance) that hold the nearest right point of each left point."""
    box = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return left.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0.0).alias("distance")).limit(0)
    level = 0
    while max(box[1] - box[0], box[3] - box[2]) > size * COARSER**level:
        level += 1
    finest = checkpoint(right.select(_cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy")).distinct())
    occupied = finest.count()
    at = lambda up, c: F.floor(F.col(c) / COARSER**up)
    # four cells at most, as none of the two sides is longer than a cell's
    tops = sorted(map(tuple, finest.select(at(level, "cx"), at(level, "cy")).distinct().collect()))
    listed = F.array(*(F.struct(F.lit(a).alias("cx"), F.lit(b).alias("cy")) for a, b in tops))
    held = left.select("id", "x", "y", F.explode(listed).alias("c")).select("id", "x", "y", "c.cx", "c.cy")
    for up in range(level - 1, -1, -1):
        cells = finest.select(at(up, "cx").alias("cx"), at(up, "cy").alias("cy")).distinct()
        cells = cells.select(F.floor(F.col("cx") / COARSER).alias("px"), F.floor(F.col("cy") / COARSER).alias("py"), "cx", "cy")
        # few cells go to the points, which would else all be dealt to them; the points never go to the cells
        few = min(occupied, len(tops) * COARSER ** (2 * (level - up))) <= SENT
        finer = held.withColumnsRenamed({"cx": "px", "cy": "py"}).join(F.broadcast(cells) if few else dealt(cells), ["px", "py"])
        side = size * COARSER**up
        near = [F.greatest(F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side, F.lit(0.0)) for c, v in (("cx", "x"), ("cy", "y"))]
        far = [F.greatest(F.abs(F.col(c) * side - F.col(v)), F.abs((F.col(c) + 1) * side - F.col(v))) for c, v in (("cx", "x"), ("cy", "y"))]
        finer = finer.withColumns({"_near": F.hypot(*near), "_far": F.hypot(*far)})
        reach = F.min("_far").over(Window.partitionBy("id")) * (1 + 1e-9)
        finer = finer.withColumn("_reach", reach if most is None else F.least(reach, F.lit(float(most))))
        held = finer.filter("_near <= _reach").select("id", "x", "y", "cx", "cy")
    points = right.select(F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    points = points.withColumns({"cx": _cell(F.col("bx"), size), "cy": _cell(F.col("by"), size)})
    d = geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    pairs = held.join(dealt(points), ["cx", "cy"]).select(F.col("id").alias("left_id"), "right_id", d.alias("distance"))
    return pairs if most is None else pairs.filter(F.col("distance") <= most)


def nearest_segment(points: DataFrame, segments: DataFrame, most: float = 40.0) -> DataFrame:
    """The nearest segment (at most `most` away) of each point: id, segmento_id, distance; null where there is none.

    points(id, x, y); segments(segmento_id, ax, ay, bx, by) are laid into the cells that they pass.
    """
    ends = ("ax", "ay", "bx", "by")
    laid = segments.select("segmento_id", *ends, F.explode(geo.cells_of(*map(F.col, ends), most)).alias("_c")).select("segmento_id", *ends, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    d = geo.segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    near = _around(points.select("id", "x", "y"), "x", "y", most).join(dealt(laid), ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= most)
    best = near.groupBy("id").agg(F.min_by(F.struct("segmento_id", "distance"), F.struct("distance", "segmento_id")).alias("b")).select("id", "b.segmento_id", "b.distance")
    return points.select("id").join(dealt(best), "id", "left")


def clip(segments: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The part of each straight piece (ax, ay, bx, by, other columns) within a box, edges included; pieces outside are dropped.

    A piece is a + t (b - a) for t from 0 to 1; each axis gives the stretch of t in which it lies between its two bounds.
    """
    start, end = [F.lit(0.0)], [F.lit(1.0)]
    for v, low, high in (("x", x0, x1), ("y", y0, y1)):
        a, d = F.col(f"a{v}"), F.col(f"b{v}") - F.col(f"a{v}")
        at = [F.try_divide(F.lit(float(bound)) - a, d) for bound in (low, high)]
        # across the axis a piece is inside all along or, starting after its end, nowhere
        level = F.when(a.between(low, high), 0.0).otherwise(2.0)
        start.append(F.when(d == 0, level).otherwise(F.least(*at)))
        end.append(F.when(d == 0, 1.0).otherwise(F.greatest(*at)))
    kept = segments.withColumns({"_from": F.greatest(*start), "_to": F.least(*end)}).filter("_from <= _to")
    point = lambda v, t, whole, own: F.when(F.col(t) == whole, F.col(own)).otherwise(F.col(f"a{v}") + F.col(t) * (F.col(f"b{v}") - F.col(f"a{v}")))
    ends = {f"a{v}": point(v, "_from", 0.0, f"a{v}") for v in "xy"} | {f"b{v}": point(v, "_to", 1.0, f"b{v}") for v in "xy"}
    return kept.withColumns(ends).drop("_from", "_to")


def cluster(points: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Chains of points at most `tolerance` apart: id, cluster (the lowest id of the chain)."""
    near = radius_join(points, points, tolerance).filter("left_id < right_id")
    parts = connected_components(near, "left_id", "right_id").withColumnRenamed("node", "id")
    return points.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def first_of_each(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row of each key: the first in the order given."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")
