import heapq
import math

import pytest
from pyspark.sql import functions as F

from meshwright import catalog
from meshwright import fixtures as fx
from meshwright.operators import routes


def shortest(steps, source, target, street):
    """Dijkstra's search with (metres, segments) as its cost; of equal ones the least predecessor and segment."""
    best, queue = {source: (0.0, 0, None, None)}, [(0.0, 0, source)]
    while queue:
        metres, hops, node = heapq.heappop(queue)
        if (metres, hops) > best[node][:2]:
            continue
        for other, segment, length, calle in steps.get(node, ()):
            if street is not None and calle != street:
                continue
            label = (metres + length, hops + 1, node, segment)
            old = best.get(other)
            if old is None or label[:2] < old[:2]:
                heapq.heappush(queue, (*label[:2], other))
            if old is None or label[:2] < old[:2] or (label[:2] == old[:2] and old[2] is not None and label < old):
                best[other] = label
    if target not in best:
        return None
    segments, at = [], target
    while at != source:
        segments.insert(0, best[at][3])
        at = best[at][2]
    return best[target][0], segments


def network_of(segments):
    steps, on = {}, {}
    for r in segments:
        for a, b in ((r.u, r.v), (r.v, r.u)):
            steps.setdefault(a, []).append((b, r.segmento_id, r.largo_m, r.calle_id))
            on.setdefault(a, set()).update({r.calle_id} - {None})
    return steps, on


def leg(steps, on, source, target):
    """metres, segments, streets of one leg."""
    shared = sorted(on.get(source, set()) & on.get(target, set()))
    held = [(w[0], c, w[1]) for c in shared if (w := shortest(steps, source, target, c))]
    if held:
        metres, street, segments = min(held)
        return metres, segments, [street]
    way = shortest(steps, source, target, None)
    return way and (*way, shared)


def way_of(steps, source, target, street):
    return shortest(steps, source, target, street) or shortest(steps, source, target, None)


def whole_row(steps, on, at, names, row, points):
    metres, segments, used = 0.0, [], set()

    def take(way, calles):
        nonlocal metres
        metres += way[0]
        segments.extend(way[1])
        used.update(calles)

    for a, b in zip(row.esquinas, row.esquinas[1:]):
        found = leg(steps, on, a, b)
        if found:
            take(found, found[2])

    def entry(p, street):
        corners = [(math.hypot(p.x - at[n][0], p.y - at[n][1]), n) for n in on if street in on[n]]
        return min(corners, default=None)

    def is_own(p, street):
        return bool(p.calle) and names[street].lower() == p.calle.lower()

    points = sorted(points, key=lambda p: p.punto)
    if not row.esquinas:
        if len(points) >= 2:
            a, b = points[:2]
            own = (a.calle or b.calle or "").lower()
            same = [c for c in row.calles if names[c].lower() == own]
            for street in sorted(same or row.calles):
                ea, eb = entry(a, street), entry(b, street)
                way = ea and eb and way_of(steps, ea[1], eb[1], street)
                if way:
                    take(way, [street])
                    break
        return segments, sorted(used), metres
    for p in points:
        options = []
        for place, end in enumerate((row.esquinas[0], row.esquinas[-1])):
            entries = [(not is_own(p, c), *entry(p, c)[:1], c, entry(p, c)[1]) for c in on.get(end, ()) if c in row.calles and entry(p, c)]
            if entries:
                other, far, street, node = min(entries)
                way = way_of(steps, node, end, street)
                if way:
                    options.append((other, far + way[0], place, street, way))
        if options:
            best = min(options, key=lambda o: o[:3])
            take(best[4], [best[3]])
    return segments, sorted(used), metres


@pytest.fixture(scope="module")
def grid(spark, sf_dir):
    return fx.grid_road(spark, sf_dir).withColumnRenamed("calle", "calle_id")


def test_routes_keep_to_a_street_or_go_any_way(spark, grid):
    segments = grid.collect()
    steps, on = network_of(segments)
    trips = [(i, i * 7 % 200, [i * 7 % 200 + 2, (i * 7 + 100) % 200, (i * 11 + 52) % 200, i * 7 % 200][i % 4]) for i in range(60)] + [(99, None, 3), (100, 3, None), (101, 3, 10**6)]
    found = routes.routes(grid, spark.createDataFrame(trips, "trip int, source long, target long")).collect()
    want = {t: leg(steps, on, a, b) for t, a, b in trips if a is not None and b is not None}
    assert {r.trip: (r.metres, r.segmentos, r.calles) for r in found} == {t: w for t, w in want.items() if w}
    assert any(r.calle_id is None and r.segmentos for r in found) and any(r.calle_id and len(r.segmentos) > 1 for r in found)


def test_ties_zero_lengths_and_parallel_segments(spark):
    """Of equal ways that of fewer segments, then the least predecessor; segments of no length make no circles."""
    rows = [(1, 0, 1, 1.0, "a"), (2, 1, 3, 1.0, "b"), (3, 0, 2, 1.0, "c"), (4, 2, 3, 1.0, "d"), (5, 0, 3, 2.0, None), (6, 3, 4, 0.0, "e"), (7, 4, 3, 0.0, "e"), (8, 4, 5, 0.0, None), (9, 4, 5, 0.0, "e"), (10, 0, 0, 1.0, "a")]
    segments = spark.createDataFrame(rows, "segmento_id long, u long, v long, largo_m double, calle_id string")
    trips = spark.createDataFrame([("x", 0, 3), ("y", 0, 5), ("z", 3, 5), ("0", 0, 0)], "trip string, source long, target long")
    found = {r.trip: (r.metres, r.segmentos, r.calle_id) for r in routes.routes(segments, trips).collect()}
    assert found == {"x": (2.0, [5], None), "y": (2.0, [5, 6, 8], None), "z": (0.0, [6, 9], "e"), "0": (0.0, [], "a")}


def test_nothing_to_walk(spark, grid):
    none = spark.createDataFrame([], "trip long, source long, target long")
    assert routes.routes(grid, none).count() == 0
    one = spark.createDataFrame([(1, 2, 3)], "trip long, source long, target long")
    assert routes.routes(grid.limit(0), one).count() == 0


def test_components_are_made_only_for_what_isn_t_reached(spark, monkeypatch):
    """Two lines of corners: a trip's near target needs no components of the network, one on the other line ends its search by them."""
    asked, keep = [], routes.connected_components
    monkeypatch.setattr(routes, "connected_components", lambda *a: asked.append(a) or keep(*a))
    monkeypatch.setattr(routes, "PATIENCE", 3, raising=False)
    rows = [(i, i, i + 1, 1.0, None) for i in [*range(9), *range(100, 103)]]
    segments = spark.createDataFrame(rows, "segmento_id long, u long, v long, largo_m double, calle_id string")

    def found(*trips):
        at = spark.createDataFrame(trips, "trip string, source long, target long")
        return {r.trip: (r.metres, r.segmentos) for r in routes.routes(segments, at).collect()}

    near = {"near": (2.0, [0, 1]), "self": (0.0, [])}
    assert found(("near", 0, 2), ("self", 5, 5), ("nowhere", 900, 900)) == near and not asked
    far = ("far", 0, 9), ("other", 0, 101), ("lone", 102, 4)
    assert found(("near", 0, 2), ("self", 5, 5), ("nowhere", 900, 900), ("beyond", 0, 900), *far) == near | {"far": (9.0, list(range(9)))} and len(asked) == 1


def test_rows_with_loose_points(spark, sf_dir, grid):
    streets, rows, points = catalog._route_rows(spark, sf_dir)
    steps, on = network_of(grid.collect())
    at = {r.node: (r.x, r.y) for r in fx.grid_nodes(spark, sf_dir).collect()}
    names = {r.calle_id: r.nombre for r in streets.collect()}
    of = {}
    for p in points.collect():
        of.setdefault(p.fila, []).append(p)
    found = routes.row_routes(grid, fx.grid_nodes(spark, sf_dir), streets, rows, points).collect()
    want = {r.fila: whole_row(steps, on, at, names, r, of.get(r.fila, [])) for r in rows.collect()}
    assert {r.fila: (r.segmentos, r.calles, pytest.approx(r.metres)) for r in found} == want
    bare = routes.row_routes(grid, fx.grid_nodes(spark, sf_dir), streets, rows.withColumn("esquinas", F.array().cast("array<bigint>")))
    assert {(tuple(r.segmentos), tuple(r.calles), r.metres) for r in bare.collect()} == {((), (), 0.0)}
