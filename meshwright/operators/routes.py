"""Routes with their segments: least-weight searches that keep predecessors, walked back from each target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from meshwright.functions import geo
from meshwright.operators.components import connected_components
from meshwright.operators.edges import swapped
from meshwright.operators.network import street_junctions
from meshwright.plans.materialise import checkpoint, dealt

#: Steps back that one job takes.
STRIDE = 8
#: Rounds after which a free search asks for the components of what it hasn't reached.
PATIENCE = 8


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out &= a[x] == b[y]
    return out


def least_paths(arcs: DataFrame, trips: DataFrame, held: tuple[str, ...] = (), parts: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The least-weight path of each of trips(source, target, *held): these columns, metres, segmentos (in order).

    arcs(src, dst, segmento_id, largo_m, *held) are followed from src to dst, those of a search only where the columns `held` are
    equal (a street, so that the path doesn't leave it). Weights aren't negative. Of equally long paths the one of fewer segments counts, then at each node the least
    predecessor and segment. A trip to its own source has no segments; one that no path serves is left out, as is one with a null end.

    Trips with a source (and street) in common share a search. A round relaxes what improved in the last one, and stops short of the
    farthest target once all are reached; the tree of predecessors is then walked back from the targets only, STRIDE steps a job.
    A search for what lies in another component would see all of its own: `parts` makes (node, component) of the whole network, which is asked for only
    if after PATIENCE rounds a target isn't reached, and ends such searches.
    """
    keys = ["source", *held]
    wanted = checkpoint(trips.select(*keys, "target").dropna().distinct())
    order = F.struct("largo_m", "segmento_id")
    steps = checkpoint(arcs.groupBy("src", "dst", *held).agg(F.min(order).alias("s")).select("src", "dst", *held, "s.*"))
    none, no_segment = F.lit(None).cast(dict(arcs.dtypes)["src"]), F.lit(None).cast(dict(arcs.dtypes)["segmento_id"])
    start = wanted.select(*keys).distinct().withColumns({"node": F.col("source"), "total": F.lit(0.0), "hops": F.lit(0), "previous": none, "segment": no_segment})
    label = F.struct("total", "hops", "previous", "segment")
    best, rounds = checkpoint(start.withColumn("changed", F.lit(True))), 0
    while True:
        if parts is not None and rounds == PATIENCE:
            wanted = _within_parts(wanted, best, keys, parts)
        rounds += 1
        # beyond the farthest target of a search nothing is relaxed, once all its targets are reached
        there = best.select(*keys, F.col("node").alias("target"), "total")
        reach = wanted.join(there, [*keys, "target"], "left").groupBy(*keys)
        reach = reach.agg(F.when(F.count("total") == F.count("*"), F.max("total")).alias("reach"))
        ahead = best.filter("changed").join(reach, keys).filter("reach is null or total <= reach")
        on = _same(ahead, steps, ("node", "src"), *((h, h) for h in held))
        moved = ahead.join(steps, on).select(
            *(ahead[k] for k in keys), F.col("dst").alias("node"), (F.col("total") + F.col("largo_m")).alias("total"),
            (F.col("hops") + 1).alias("hops"), ahead["node"].alias("previous"), F.col("segmento_id").alias("segment"),
        )
        known = best.select(*keys, "node", label.alias("label"), F.struct("total", "hops").alias("known"))
        new = moved.select(*keys, "node", label.alias("label"), F.lit(None).cast(known.schema["known"].dataType).alias("known"))
        merged = known.unionByName(new).groupBy(*keys, "node").agg(F.min("label").alias("label"), F.min("known").alias("known"))
        changed = F.col("known").isNull() | (F.struct("label.total", "label.hops") < F.col("known"))
        seen = Observation()
        best = checkpoint(merged.select(*keys, "node", "label.*", changed.alias("changed")).observe(seen, F.count_if("changed").alias("n")))
        if not seen.get["n"]:
            break
    ends = best.select(*keys, F.col("node").alias("target"), F.col("total").alias("metres")).join(wanted, [*keys, "target"])
    walks = ends.select("*", F.col("target").alias("at"), F.array().cast(f"array<{dict(arcs.dtypes)['segmento_id']}>").alias("segmentos"))
    back = best.filter("previous is not null").select(*keys, F.col("node").alias("at"), "previous", "segment")
    while True:
        for _ in range(STRIDE):
            walks = walks.join(back, [*keys, "at"], "left").select(
                *keys, "target", "metres", F.coalesce("previous", "at").alias("at"),
                F.when(F.col("previous").isNull(), F.col("segmentos")).otherwise(F.concat(F.array("segment"), "segmentos")).alias("segmentos"),
            )
        seen = Observation()
        walks = checkpoint(walks.observe(seen, F.count_if(F.col("at") != F.col("source")).alias("n")))
        if not seen.get["n"]:
            return walks.drop("at")


def _within_parts(wanted: DataFrame, best: DataFrame, keys: list[str], parts: Callable[[], DataFrame]) -> DataFrame:
    """wanted without the targets that `best` lacks and that lie in another component than their source."""
    there = best.select(*keys, F.col("node").alias("target"))
    missed = checkpoint(wanted.join(there, [*keys, "target"], "left_anti"))
    if missed.isEmpty():
        return wanted
    nodes = checkpoint(parts())
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    reachable = missed.join(of("source"), "source").join(of("target"), "target").filter("source_part = target_part")
    return checkpoint(wanted.join(there, [*keys, "target"], "left_semi").unionByName(reachable.select(wanted.columns)))


def _arcs(segments: DataFrame) -> DataFrame:
    ahead = segments.select(F.col("u").alias("src"), F.col("v").alias("dst"), "segmento_id", F.col("largo_m").cast("double").alias("largo_m"), "calle_id")
    return ahead.unionByName(swapped(ahead))


def _walked(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """trip, calle_id, rank, metres, segmentos of the first of each trip's candidates wanted(trip, source, target, calle_id) along its
    street, or else, without calle_id, along any. `rank` orders candidates; metres and calle_id break ties."""
    arcs, wanted = _arcs(segments), checkpoint(wanted)
    on_street = wanted.filter("calle_id is not null")
    found = on_street.join(least_paths(arcs.filter("calle_id is not null"), on_street, ("calle_id",)), ["source", "target", "calle_id"])
    columns = ["trip", "calle_id", "rank", "metres", "segmentos"]
    first = F.min_by(F.struct(*columns[1:]), F.struct("rank", "metres", "calle_id")).alias("b")
    found = checkpoint(found.groupBy("trip").agg(first).select("trip", "b.*"))
    rest = wanted.join(found.select("trip"), "trip", "left_anti").groupBy("trip").agg(F.min_by(F.struct("source", "target", "rank"), F.struct("rank", "source", "target")).alias("b"))
    rest = rest.select("trip", "b.*")
    # ends that no segment has
    ends = arcs.select("src")
    for end in ("source", "target"):
        rest = rest.join(dealt(ends.withColumnRenamed("src", end)), end, "left_semi")
    rest = checkpoint(rest)
    if rest.isEmpty():
        return found
    free = rest.join(least_paths(arcs, rest, parts=lambda: connected_components(segments, "u", "v")), ["source", "target"]).withColumn("calle_id", F.lit(None).cast("string"))
    return found.unionByName(free.select(*columns))


def routes(segments: DataFrame, trips: DataFrame) -> DataFrame:
    """How to get from one corner to another, block by block: trip, calle_id, calles, metres, segmentos.

    segments(segmento_id, u, v, largo_m, calle_id) are walked both ways; trips(trip, source, target) have distinct names. A trip keeps to a street that both its corners
    lie on, of several to that with the shortest way (ties: the least calle_id). Where no such street leads there, it takes the shortest way by any segment: then calle_id is null. calles are
    the streets that the trip goes along: the one that it keeps to, or all that its corners share. A trip that no way serves is left out.
    """
    # both are read many times
    segments, trips = checkpoint(segments.select("segmento_id", "u", "v", "largo_m", "calle_id")), checkpoint(trips.select("trip", "source", "target"))
    corners = checkpoint(street_junctions(segments))
    at = lambda end: corners.select(F.col("nodo_id").alias(end), "calle_id")
    shared = trips.join(at("source"), "source").join(at("target"), ["target", "calle_id"]).select("trip", "source", "target", "calle_id")
    shared = checkpoint(shared)
    alone = trips.select("trip", "source", "target").join(shared.select("trip").distinct(), "trip", "left_anti")
    wanted = shared.unionByName(alone.withColumn("calle_id", F.lit(None).cast("string"))).withColumn("rank", F.lit(0))
    names = shared.groupBy("trip").agg(F.sort_array(F.collect_set("calle_id")).alias("shared"))
    found = _walked(segments, wanted).join(names, "trip", "left")
    calles = F.when(F.col("calle_id").isNotNull(), F.array("calle_id")).otherwise(F.coalesce("shared", F.array().cast("array<string>")))
    return found.select("trip", "calle_id", calles.alias("calles"), "metres", "segmentos")


def row_routes(segments: DataFrame, nodes: DataFrame, streets: DataFrame, rows: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The segments that each row of a result goes along: fila, segmentos (in order, points' ways last), calles (sorted), metres.

    rows(fila, esquinas array<node>, calles array<calle_id>): the corners where a route turns, in order, and the streets that the row names. Neighbouring
    corners are joined as in routes(); a pair that no way serves is passed over. points(fila, punto, x, y, calle) are the row's loose points with the name of their
    street, if known. A point enters a street at the street's nearest corner. It goes to whichever end of the route its own street leads to, else to the nearer by
    way and entry; along its own street, else that of the row's streets whose corner is nearest, else by any segment. Without
    corners the first two points are joined along the street that both have, else along the first of the row's streets that has a way.

    nodes(node, x, y); streets(calle_id, nombre). Names are compared without case. Rows without corners and points have empty lists.
    """
    rows = checkpoint(rows.select("fila", F.coalesce("esquinas", F.array().cast(dict(rows.dtypes)["esquinas"])).alias("esquinas"), "calles"))
    pair = F.arrays_zip(F.slice("esquinas", F.lit(1), F.greatest(F.size("esquinas") - 1, F.lit(0))).alias("source"), F.slice("esquinas", F.lit(2), F.greatest(F.size("esquinas") - 1, F.lit(0))).alias("target"))
    legs = rows.select("fila", F.posexplode(pair).alias("place", "p")).select(F.struct("fila", "place").alias("trip"), "p.*")
    walked = routes(segments, legs).select("trip.fila", "trip.place", "calles", "metres", "segmentos")
    if points is not None:
        walked = walked.unionByName(_points_joined(segments, nodes, streets, rows, points))
    parts = walked.groupBy("fila").agg(F.sort_array(F.collect_list(F.struct("place", "segmentos", "calles", "metres"))).alias("parts"))
    part = lambda name: F.transform("parts", lambda p: p[name])
    out = rows.select("fila").join(parts, "fila", "left").select(
        "fila", F.flatten(part("segmentos")).alias("segmentos"), F.array_sort(F.array_distinct(F.flatten(part("calles")))).alias("calles"),
        F.aggregate(part("metres"), F.lit(0.0), lambda a, m: a + m).alias("metres"),
    )
    kinds = dict(out.dtypes)
    return out.select("fila", *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("segmentos", "calles")), F.coalesce("metres", F.lit(0.0)).alias("metres"))


def _points_joined(segments: DataFrame, nodes: DataFrame, streets: DataFrame, rows: DataFrame, points: DataFrame) -> DataFrame:
    """fila, place (after all legs, in the order of punto), calles, metres, segmentos of each loose point's way."""
    corners = checkpoint(street_junctions(segments).join(nodes.select(F.col("node").alias("nodo_id"), F.col("x").alias("cx"), F.col("y").alias("cy")), "nodo_id"))
    named = streets.select("calle_id", F.lower("nombre").alias("nombre"))
    points = checkpoint(points.select("fila", "punto", "x", "y", F.lower("calle").alias("own")))
    of_row = rows.select("fila", F.explode("calles").alias("calle_id")).distinct().join(named, "calle_id", "left")
    # where each point enters each of its row's streets
    entry = points.join(of_row, "fila").join(corners, "calle_id")
    far = geo.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    entry = entry.groupBy("fila", "punto", "calle_id").agg(
        F.min_by("nodo_id", F.struct(far, "nodo_id")).alias("entry"), F.min(far).alias("far"), F.first(F.coalesce(F.col("own") == F.col("nombre"), F.lit(False))).alias("is_own")
    )
    entry = checkpoint(entry)
    ends = rows.filter(F.size("esquinas") > 0).select("fila", F.posexplode(F.array(F.element_at("esquinas", 1), F.element_at("esquinas", -1))).alias("end", "nodo_id"))
    reached = ends.join(corners.select("nodo_id", "calle_id"), "nodo_id").join(entry, ["fila", "calle_id"])
    first = F.min_by(F.struct("nodo_id", "calle_id", "entry", "far", "is_own"), F.struct(~F.col("is_own"), "far", "calle_id")).alias("b")
    option = checkpoint(reached.groupBy("fila", "punto", "end").agg(first).select("fila", "punto", "end", "b.*"))
    trip = F.struct("fila", "punto", "end").alias("trip")
    wanted = option.select(trip, F.col("entry").alias("source"), F.col("nodo_id").alias("target"), "calle_id", F.lit(0).alias("rank"))
    way = _walked(segments, wanted).select("trip.fila", "trip.punto", "trip.end", "metres", "segmentos")
    chosen = F.min_by(F.struct("calle_id", (F.col("metres")).alias("metres"), "segmentos"), F.struct(~F.col("is_own"), F.col("far") + F.col("metres"), "end")).alias("b")
    joined = option.join(way, ["fila", "punto", "end"]).groupBy("fila", "punto").agg(chosen).select("fila", "punto", F.col("b.calle_id").alias("calle_id"), "b.metres", "b.segmentos")
    # rows without corners: their first two points
    two = points.join(rows.filter(F.size("esquinas") == 0).select("fila"), "fila").groupBy("fila").agg(F.slice(F.sort_array(F.collect_list(F.struct("punto", "own"))), 1, 2).alias("p")).filter(F.size("p") == 2)
    two = two.select("fila", F.col("p")[0]["punto"].alias("a"), F.col("p")[1]["punto"].alias("b"), F.coalesce(F.col("p")[0]["own"], F.col("p")[1]["own"]).alias("own"))
    side = lambda k: entry.select("fila", F.col("punto").alias(k), "calle_id", F.col("entry").alias("source" if k == "a" else "target"))
    both = two.join(side("a"), ["fila", "a"]).join(side("b"), ["fila", "b", "calle_id"]).join(named, "calle_id", "left")
    both = both.withColumn("common", F.coalesce(F.col("own") == F.col("nombre"), F.lit(False)))
    both = both.withColumn("any_common", F.max("common").over(Window.partitionBy("fila"))).filter("common or not any_common")
    place = F.dense_rank().over(Window.partitionBy("fila").orderBy("calle_id"))
    both = checkpoint(both.select(F.struct("fila", F.col("calle_id").alias("street")).alias("trip"), "source", "target", "calle_id", place.alias("rank"), F.col("a").alias("punto")))
    way = _walked(segments, both).select("trip", "rank", "metres", "segmentos")
    met = both.select("trip", "punto").join(way, "trip")
    met = met.groupBy("trip.fila").agg(F.min_by(F.struct("punto", F.col("trip.street").alias("calle_id"), "metres", "segmentos"), "rank").alias("b")).select("fila", "b.*")
    found = joined.unionByName(met.select("fila", "punto", "calle_id", "metres", "segmentos"))
    order = F.row_number().over(Window.partitionBy("fila").orderBy("punto")) + (1 << 30)
    return found.select("fila", order.alias("place"), F.array("calle_id").alias("calles"), "metres", "segmentos")
