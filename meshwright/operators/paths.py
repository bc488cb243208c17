"""Path search as loops of joins: each round moves all frontiers of all seeds by one edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshwright.operators.components import connected_components
from meshwright.operators.edges import swapped
from meshwright.plans.materialise import checkpoint


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """An undirected edge in both orientations, a loop once."""
    return edges.unionByName(swapped(edges.filter(F.col(src) != F.col(dst)), src, dst))


#: Rounds after which the nodes that were reached are written together.
COMPACT = 8


def any_shortest(
    edges: DataFrame,
    seeds: DataFrame,
    targets: DataFrame | None = None,
    weight: str | None = None,
    cap: float | None = None,
    most_hops: int | None = None,
    least_hops: int = 0,
    on_the_way: bool = False,
) -> DataFrame:
    """For each seed and node one path with the fewest edges: seed, node, hops, total (of `weight`).

    edges(src, dst[, weight]) are followed from src to dst. Of paths with equally few edges the one with the least total is taken. `cap` is
    a condition on the chosen path (total < cap), never a way to choose another: longer paths still mark their nodes as
    reached. As weights aren't negative, a seed stops once its whole frontier is at the cap. least_hops=1 leaves out a
    seed itself unless a walk comes back to it. With targets the search ends when every seed has found them all, and only
    they are returned, or with on_the_way all that was reached until then.

    A round is one job: what it finds, and how many targets are among that, is counted while it is written. It shuffles the frontier and,
    for the anti-join, what was reached, which is written together each COMPACT rounds.
    """
    cost = F.col(weight).cast("double") if weight else F.lit(0.0)
    steps = checkpoint(edges.groupBy("src", "dst").agg(F.min(cost).alias("cost")))
    start = seeds.select(F.col("node").alias("seed"), "node").distinct().select("seed", "node", F.lit(0).alias("hops"), F.lit(0.0).alias("total"))
    wanted = None if targets is None else checkpoint(targets.select("node").distinct().withColumn("wanted", F.lit(True)))
    frontier = start = checkpoint(start)
    reached = start if least_hops == 0 else start.limit(0)
    missing = None
    if wanted is not None:
        missing = start.count() * wanted.count() - reached.join(wanted, "node", "left_semi").count()
    hops = 0
    while (most_hops is None or hops < most_hops) and missing != 0:
        hops += 1
        ahead = frontier
        if cap is not None:  # a seed with nothing below the cap is done
            ahead = frontier.join(frontier.filter(F.col("total") < cap).select("seed").distinct(), "seed", "left_semi")
        moved = ahead.join(steps, ahead["node"] == steps["src"]).groupBy("seed", F.col("dst").alias("node"))
        moved = moved.agg(F.min(F.col("total") + F.col("cost")).alias("total"))
        fresh = moved.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        fresh = fresh.select("seed", "node", F.lit(hops).alias("hops"), "total")
        seen, hit = Observation(), F.count(F.lit(None))
        if wanted is not None:
            fresh, hit = fresh.join(wanted, "node", "left"), F.count("wanted")
        frontier = checkpoint(fresh.observe(seen, F.count("*").alias("n"), hit.alias("hits"))).select("seed", "node", "hops", "total")
        if not seen.get["n"]:
            break
        reached = reached.unionByName(frontier)
        if hops % COMPACT == 0:
            reached = checkpoint(reached)
        if missing is not None:
            # this level is complete, so ties are
            missing -= seen.get["hits"]
    if wanted is not None and not on_the_way:
        reached = reached.join(wanted, "node", "left_semi").select("seed", "node", "hops", "total")
    return reached.filter(F.col("total") < cap) if cap is not None else reached


def group(rows: DataFrame, start: str, end: str, *lists: str) -> DataFrame:
    """One round of a quantified group as edges: src, dst and via, a struct of the round's variables that become lists.

    rows are those of a pattern for one round, such as street - corner - street; each of its matches is an edge of its own.
    """
    return rows.select(F.col(start).alias("src"), F.col(end).alias("dst"), F.struct(*lists).alias("via")).filter("src != dst")


def all_shortest(edges: DataFrame, seeds: DataFrame, targets: DataFrame, most_hops: int | None = None) -> DataFrame:
    """All paths with the fewest edges from each seed to each target: seed, target, hops, path (nodes in order).

    If edges have a column via (see group), the values of a path's edges are listed in order as vias; parallel edges are paths of their own.
    Distances are found first, no further than to the farthest target; then paths grow back from the targets along edges that lie
    on a shortest path, so that no path is built that doesn't end in a target.
    """
    found = any_shortest(edges, seeds, targets, most_hops=most_hops, on_the_way=True)
    levels = checkpoint(found.select("seed", "node", "hops"))
    listed = "via" in edges.columns
    ends = levels.join(targets.select("node").distinct(), "node", "left_semi")
    vias = [F.array().cast(f"array<{dict(edges.dtypes)['via']}>").alias("vias")] if listed else []
    node = F.col("node")
    paths = ends.select("seed", node.alias("target"), "hops", node.alias("at"), F.array("node").alias("path"), F.col("hops").alias("left"), *vias)
    paths = checkpoint(paths)
    back = checkpoint(edges.select("src", "dst", *(["via"] if listed else [])))
    before = levels.select("seed", F.col("node").alias("src"), F.col("hops").alias("_h"))
    vias = [F.concat(F.array("via"), "vias").alias("vias")] if listed else []
    done = [paths.filter("left = 0")]
    while True:
        step = paths.filter("left > 0").join(back, F.col("at") == F.col("dst")).join(before, ["seed", "src"])
        step = step.filter(F.col("_h") == F.col("left") - 1)
        longer = F.concat(F.array("src"), "path").alias("path")
        step = step.select("seed", "target", "hops", F.col("src").alias("at"), longer, (F.col("left") - 1).alias("left"), *vias)
        seen = Observation()
        paths = checkpoint(step.observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            break
        done.append(paths.filter("left = 0"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("seed", "target", "hops", "path", *(["vias"] if listed else []))


def hops_to_nearest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Fewest edges from any source to each reachable node: one search from all sources at once (node, hops)."""
    steps = checkpoint(edges.select("src", "dst").distinct())
    frontier = reached = checkpoint(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while True:
        hops += 1
        moved = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        seen = Observation()
        fresh = moved.join(reached, "node", "left_anti").withColumn("hops", F.lit(hops))
        frontier = checkpoint(fresh.observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            return reached
        reached = reached.unionByName(frontier)
        if hops % COMPACT == 0:
            reached = checkpoint(reached)


def nearest_places(reached: DataFrame, anchors: DataFrame, most: float | None = None) -> DataFrame:
    """Places by their network distance: seed, place, total, from reached(seed, node, total) and anchors(place, node).

    The nearest anchor of a place counts. `most` leaves out what is farther; sort by total for the order in which they are met.
    """
    near = reached if most is None else reached.filter(F.col("total") <= most)
    return near.join(anchors, "node").groupBy("seed", "place").agg(F.min("total").alias("total"))


def isochrone(edges: DataFrame, seeds: DataFrame, weight: str, cap: float) -> DataFrame:
    """Least total weight, if at most `cap`, from each seed to each node (seed, node, total), by relaxation of what improved last."""
    steps = checkpoint(edges.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("cost")))
    best = improved = checkpoint(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("total", F.lit(0.0)))
    while True:
        moved = improved.join(steps, improved["node"] == steps["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.col("total") + F.col("cost")).alias("total")).filter(F.col("total") <= cap)
        known = best.withColumnRenamed("total", "_known")
        improved = checkpoint(moved.join(known, ["seed", "node"], "left").filter(F.col("_known").isNull() | (F.col("total") < F.col("_known"))).select("seed", "node", "total"))
        if not improved.limit(1).count():
            return best
        best = checkpoint(best.unionByName(improved).groupBy("seed", "node").agg(F.min("total").alias("total")))


def reachable_segments(segments: DataFrame, reached: DataFrame) -> DataFrame:
    """Segments(u, v, ...) both of whose ends are in reached(node)."""
    nodes = reached.select("node").distinct()
    at_u = segments.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi")
    return at_u.join(nodes.withColumnRenamed("node", "v"), "v", "left_semi")


def giant_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes of the largest component (of several, the one with the least label)."""
    parts = checkpoint(connected_components(edges, src, dst))
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return parts.join(F.broadcast(largest.select("component")), "component", "left_semi").select("node")
