"""Areas: covers of grid cells, points within areas, clipping by areas and boxes, unions of areas that share edges.

Polygons are polygon_id and rings, array<array<struct<x,y>>> of closed rings, the outer one first; a point is inside where an odd number of rings hold it.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.operators.components import connected_components
from meshwright.plans.materialise import checkpoint, dealt


def edges_of(polygons: DataFrame) -> DataFrame:
    """polygon_id, ax, ay, bx, by of every edge of every ring; edges without length are left out."""
    step = polygons.select("polygon_id", F.explode("rings").alias("ring")).select("polygon_id", F.explode(geo.steps("ring")).alias("s"))
    return step.select("polygon_id", *(F.col(f"s.{e}.{v}").alias(f"{e}{v}") for e in "ab" for v in "xy")).filter("ax != bx or ay != by")


_ENDS = ("ax", "ay", "bx", "by")


#: The grid's lines lie this part of a cell beside round coordinates, so that vertices and slanted edges don't meet its corners.
SHIFT = (math.sqrt(5) - 1) / 2


def _cells(size: float) -> Column:
    """The cells that the edge ax, ay, bx, by passes."""
    return F.explode(geo.cells_of(*(F.col(c) - SHIFT * size for c in _ENDS), size)).alias("c")


def _crossing(a: Column, b: Column, c: Column, d: Column, at: Column) -> Column:
    """The other coordinate where an edge from (a, c) to (b, d) has the first one at `at`."""
    return F.when(a == at, c).when(b == at, d).otherwise((d - c) * (at - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a) + c)


def cover(polygons: DataFrame, size: float) -> DataFrame:
    """Cells of a quadtree that cover each polygon: polygon_id, level, cx, cy, edges, corner.

    A cell of level n has the side size * 2**n. Cells that edges cross are of level 0 and hold those edges alone, and whether their lower left corner lies inside;
    cells without edges hold null, lie inside whole and are as large as they can be. So a polygon has as many cells as its outline
    is long, not as its area is large, and no cell carries its rings.

    Which corners lie inside is told row by row: of all places where edges cross a row's lower line, those right of a corner are counted by a running sum.
    """
    return _covered(polygons, size)[0]


def _covered(polygons: DataFrame, size: float) -> tuple[DataFrame, int]:
    """The cells of cover(), and how many levels they may have: as many as the widest polygon has halvings."""
    edges = edges_of(polygons)
    crossed = edges.select("polygon_id", *_ENDS, _cells(size)).select("polygon_id", "c.cx", "c.cy", *_ENDS)
    mixed = checkpoint(crossed.groupBy("polygon_id", "cx", "cy").agg(F.collect_list(F.struct(*_ENDS)).alias("edges")))
    spread = mixed.groupBy("polygon_id").agg(*((F.max(c) - F.min(c) + 1).alias(c) for c in ("cx", "cy")))
    widest = spread.agg(F.max(F.greatest("cx", "cy"))).first()[0] or 1
    top = max(0, math.ceil(math.log2(widest)))
    up = lambda n: mixed.select("polygon_id", *(F.floor(F.col(c) / 2**n).cast("long").alias(c) for c in ("cx", "cy"))).distinct()
    corners = mixed.select("polygon_id", F.lit(0).alias("level"), "cx", "cy", "edges")
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    for n in range(top):
        children = up(n + 1).withColumn("dx", half).withColumn("dy", half).select("polygon_id", (F.col("cx") * 2 + F.col("dx")).alias("cx"), (F.col("cy") * 2 + F.col("dy")).alias("cy"))
        plain = children.join(up(n), ["polygon_id", "cx", "cy"], "left_anti")
        corners = corners.unionByName(plain.select("polygon_id", F.lit(n).alias("level"), "cx", "cy", F.lit(None).cast(mixed.schema["edges"].dataType).alias("edges")))
    side = F.expr("shiftleft(1L, level)")
    row = (F.col("cy") * side).alias("row")
    corners = corners.select("*", row, ((F.col("cx") * side).cast("double") * size + SHIFT * size).alias("at"))
    # where edges cross the lower line of each row: y is the line's for its lower end, not for its upper one
    first, last = F.ceil(F.least("ay", "by") / size - SHIFT), F.ceil(F.greatest("ay", "by") / size - SHIFT) - 1
    lines = edges.filter(first <= last).select("polygon_id", *_ENDS, F.explode(F.sequence(first, last)).alias("row"))
    x = _crossing(*map(F.col, ("ay", "by", "ax", "bx")), F.col("row") * F.lit(float(size)) + SHIFT * size)
    marks = lines.select("polygon_id", "row", x.alias("at"), F.lit(1).alias("mark"))
    marks = marks.unionByName(corners, allowMissingColumns=True)
    right = Window.partitionBy("polygon_id", "row").orderBy(F.col("at").desc(), F.col("mark").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("corner", F.coalesce(F.sum("mark").over(right), F.lit(0)) % 2 == 1).filter("mark is null")
    return found.filter("edges is not null or corner").select("polygon_id", "level", "cx", "cy", "edges", "corner"), max(1, top)


def _held(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """(on an edge, inside) for a point in a cell of edges, on it within a billionth of a cell: the parity of its way to the cell's lower left corner, level and then down."""
    left, low = (F.col(c) * F.lit(float(size)) + SHIFT * size for c in ("cx", "cy"))

    def passed(e: Column) -> Column:
        ax, ay, bx, by = (e[c] for c in _ENDS)
        at_y, at_x = _crossing(ay, by, ax, bx, y), _crossing(ax, bx, ay, by, left)
        # the corner lies a little to the right of its lines' crossing, and less above it
        rises = (bx - ax) * (by - ay) > 0
        along = ((ay > y) != (by > y)) & (left < at_y) & (at_y <= x)
        down = ((ax > left) != (bx > left)) & ((low < at_x) | ((low == at_x) & rises)) & ((at_x < y) | ((at_x == y) & ~rises))
        return along.cast("int") + down.cast("int")

    crossings = F.aggregate("edges", F.lit(0), lambda s, e: s + passed(e))
    on = F.exists("edges", lambda e: geo.segment_distance(x, y, *(e[c] for c in _ENDS)) <= geo.NEAR * size)
    return on, (crossings % 2 == 1) != F.col("corner")


def holders(points: DataFrame, cells: DataFrame, size: float, edges: bool = False, levels: int | None = None) -> DataFrame:
    """id, polygon_id of the polygons that hold each of points(id, x, y), from their cover(); `edges` says whether points on an edge are held.

    A point is looked for at as many levels as are given, or as the cells have.
    """
    if levels is None:
        levels = (cells.agg(F.max("level")).first()[0] or 0) + 1
    at = [F.struct(F.lit(n).alias("level"), *(F.floor((F.col(v) - SHIFT * size) / (size * 2**n)).alias(f"c{v}") for v in "xy")) for n in range(levels)]
    placed = points.select("id", "x", "y", F.explode(F.array(*at)).alias("c")).select("id", "x", "y", "c.*")
    met = placed.join(dealt(cells), ["level", "cx", "cy"])
    on, inside = _held(F.col("x"), F.col("y"), size)
    return met.filter(F.col("edges").isNull() | ((on | inside) if edges else (inside & ~on))).select("id", "polygon_id")


def within_join(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """The first polygon (by polygon_id) that holds each point: id, polygon_id (null where none does). Points on an edge aren't held.

    Points meet the cells of cover(polygons, size) by equal keys: in inner cells without a test, in others with the edges that cross the cell.
    """
    cells, levels = _covered(polygons, size)
    held = holders(points, cells, size, levels=levels).groupBy("id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.select("id").join(dealt(held), "id", "left")


def clip_lines(lines: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """The parts of lines(way_id, line array<struct<x,y>>, other columns) within the union of polygons: way_id, part (from 0), line, other columns.

    Each straight piece is cut where it meets an edge, and a stretch between two cuts stays if its middle is held; stretches along an edge stay. What follows on is
    joined, also over an edge that two polygons share. Pieces meet edges and cells only where they cross the same cell. Lines of one point, or of none, go.
    """
    step = lines.select("way_id", F.posexplode(geo.steps("line")).alias("pos", "s"))
    pieces = step.select("way_id", "pos", *(F.col(f"s.{e}.{v}").alias(f"{e}{v}") for e in "ab" for v in "xy")).filter("ax != bx or ay != by")
    pieces = checkpoint(pieces)
    cells, levels = _covered(polygons, size)
    cells = checkpoint(cells)
    laid = pieces.select("way_id", "pos", *_ENDS, _cells(size)).select("way_id", "pos", *_ENDS, "c.*")
    edges = cells.filter("edges is not null").select("cx", "cy", F.explode("edges").alias("e"))
    met = laid.join(edges, ["cx", "cy"]).select("way_id", "pos", F.explode(geo.meeting(*map(F.col, _ENDS), *(F.col(f"e.{c}") for c in _ENDS))).alias("t"))
    cuts = met.filter("t > 0 and t < 1").groupBy("way_id", "pos").agg(F.collect_set("t").alias("cuts"))
    cut = pieces.join(cuts, ["way_id", "pos"], "left")
    ends = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("cuts", F.array().cast("array<double>"))))
    cut = cut.withColumn("t", ends)
    stretch = cut.select("way_id", "pos", *_ENDS, F.posexplode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("from"), F.slice("t", F.lit(2), F.size("t") - 1).alias("to"))).alias("nth", "t"))
    between = lambda v, t: F.col(f"a{v}") + t * (F.col(f"b{v}") - F.col(f"a{v}"))
    along = lambda v, t: F.when(t > 1 - geo.NEAR, F.col(f"b{v}")).when(t < geo.NEAR, F.col(f"a{v}")).otherwise(between(v, t))
    middle = (F.col("t.from") + F.col("t.to")) / 2
    stretch = stretch.filter(F.col("t.to") - F.col("t.from") > geo.NEAR)
    stretch = checkpoint(stretch.select("way_id", "pos", "nth", *_ENDS, F.col("t.from").alias("from"), F.col("t.to").alias("to"), along("x", middle).alias("x"), along("y", middle).alias("y")))
    key = F.struct("way_id", "pos", "nth").alias("id")
    held = holders(stretch.select(key, "x", "y"), cells, size, True, levels).select("id").distinct()
    kept = stretch.withColumn("id", key).join(held, "id").drop("id")
    order = Window.partitionBy("way_id").orderBy("pos", "nth")
    before = F.lag(F.struct("pos", "to")).over(order)
    on_piece = (before["pos"] == F.col("pos")) & (F.col("from") - before["to"] <= geo.NEAR)
    on_next = (before["pos"] == F.col("pos") - 1) & (before["to"] > 1 - 2 * geo.NEAR) & (F.col("from") < 2 * geo.NEAR)
    follows = on_piece | on_next
    kept = kept.withColumn("opens", F.coalesce(~follows, F.lit(True))).withColumn("part", (F.sum(F.col("opens").cast("int")).over(order) - 1).cast("int"))
    point = lambda t: F.struct(*(along(v, F.col(t)).alias(v) for v in "xy"))
    listed = kept.groupBy("way_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "nth", point("from").alias("a"), point("to").alias("b")))).alias("s"))
    # what joins two stretches of one piece is no vertex of the line
    inner = F.transform("s", lambda s, i: F.when(F.coalesce(F.get("s", i + 1)["pos"] == s["pos"], F.lit(False)), F.lit(None)).otherwise(s["b"]))
    line = F.concat(F.array(F.col("s")[0]["a"]), F.array_compact(inner)).alias("line")
    rest = [c for c in lines.columns if c not in ("way_id", "line")]
    out = listed.select("way_id", "part", line)
    return out.join(lines.select("way_id", *(F.col(f"`{c}`") for c in rest)), "way_id") if rest else out


def clip_rings(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """polygons whose rings are cut by a box (Sutherland and Hodgman); rings of which nothing is left go, as do polygons without rings."""

    def cut(v: str, bound: float, sign: int) -> Column:
        inside = lambda p: (p[v] - bound) * sign >= 0
        other = "y" if v == "x" else "x"

        def crossing(a: Column, b: Column) -> Column:
            at = a[other] + (b[other] - a[other]) * (bound - a[v]) / F.when(b[v] == a[v], F.lit(1.0)).otherwise(b[v] - a[v])
            here = {v: F.lit(float(bound)), other: at}
            return F.struct(here["x"].alias("x"), here["y"].alias("y"))

        def vertices(s: Column) -> Column:
            a, b = s["a"], s["b"]
            none = F.array().cast("array<struct<x:double,y:double>>")
            ahead = F.when(inside(b), F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))).otherwise(none)
            return F.when(inside(a) == inside(b), ahead).otherwise(F.concat(F.array(crossing(a, b)), ahead))

        closed = lambda r: F.when(F.size(r) > 0, F.concat(r, F.array(F.get(r, F.lit(0))))).otherwise(r)
        return F.transform("rings", lambda ring: closed(F.flatten(F.transform(geo.steps(ring), vertices))))

    for v, bound, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        polygons = polygons.withColumn("rings", cut(v, float(bound), sign))
    return polygons.withColumn("rings", F.filter("rings", lambda r: F.size(r) > 3)).filter(F.size("rings") > 0)


def dissolve(polygons: DataFrame, key: str) -> DataFrame:
    """The union of the polygons of each key: key, rings, area. Their edges match: neighbours share whole edges, from vertex to vertex.

    An edge that two of them share cancels out; at each vertex what is left goes on with the sharpest turn towards the inside, so that rings which touch in a vertex stay
    apart. Edges that follow on are one component, which is a ring. Outer rings run anticlockwise and holes clockwise; holes aren't told to which outer ring they belong, as
    parity does. A polygon that is there twice under one key cancels nothing but counts once.
    """
    numbered = polygons.select(F.col(key).alias("key"), F.posexplode("rings").alias("nth", "ring"))
    # outer rings anticlockwise, holes clockwise
    turn = F.when((geo.signed_area(F.col("ring")) > 0) == (F.col("nth") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    edge = numbered.select("key", F.explode(geo.steps(turn)).alias("s")).select("key", F.col("s.a").alias("a"), F.col("s.b").alias("b")).filter("a != b")
    # both directions of an edge meet in one group
    edge = edge.groupBy("key", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.bool_or(F.col("a") < F.col("b")).alias("up"), F.bool_or(F.col("a") > F.col("b")).alias("down"))
    start = lambda up, down: F.when(F.col("up"), F.col(up)).otherwise(F.col(down))
    left = checkpoint(edge.filter("up != down").select("key", start("low", "high").alias("a"), start("high", "low").alias("b")))
    # at a vertex: of the edges that leave it, the first clockwise from the one that came
    angle = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    come = left.select("key", F.col("b").alias("at"), F.col("a").alias("origin"), angle(F.col("b"), F.col("a")).alias("from"))
    go = left.select("key", F.col("a").alias("at"), F.col("b").alias("to"), angle(F.col("a"), F.col("b")).alias("towards"))
    turned = F.pmod(F.col("from") - F.col("towards"), F.lit(2 * math.pi))
    turned = F.when(turned == 0, F.lit(2 * math.pi)).otherwise(turned)
    link = come.join(dealt(go), ["key", "at"]).groupBy("key", "origin", "at").agg(F.min_by("to", F.struct(turned, "to")).alias("to"))
    of = lambda a, b: F.struct("key", F.col(a).alias("a"), F.col(b).alias("b"))
    link = checkpoint(link)
    parts = connected_components(link.select(of("origin", "at").alias("src"), of("at", "to").alias("dst")))
    rings = link.select(of("origin", "at").alias("node"), "key", "origin", "at", "to").join(dealt(parts), "node").drop("node")
    point = "struct<x:double,y:double>"
    kind = dict(polygons.dtypes)[key]
    rings = rings.groupBy("component").applyInArrow(_in_order, f"key {kind}, ring array<{point}>")
    area = geo.signed_area(F.col("ring"))
    out = rings.select("key", "ring", area.alias("area")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(-F.col("area"), "ring"))).alias("r"), F.sum("area").alias("area"))
    return out.select(F.col("key").alias(key), F.transform("r", lambda r: r["ring"]).alias("rings"), "area")


def _in_order(ring: pa.Table) -> pa.Table:
    """The vertices of one ring in order, from its least edge, closed; it may meet itself in a vertex."""
    point = lambda p: (p["x"], p["y"])
    ahead = {(point(a), point(b)): (point(b), point(c)) for a, b, c in zip(*(ring[c].to_pylist() for c in ("origin", "at", "to")))}
    first = min(ahead)
    out, at = [first[0], first[1]], ahead[first]
    while at != first:
        out.append(at[1])
        at = ahead[at]
    return pa.table({"key": ring["key"].slice(0, 1), "ring": pa.array([[{"x": x, "y": y} for x, y in out]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})
