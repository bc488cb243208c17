"""Plans that must hold on tables of any size: what Spark estimates too low isn't sent whole to all executors."""

import pytest
from pyspark.sql import functions as F

from meshwright import catalog
from meshwright import fixtures as fx
from meshwright.graph import PropertyGraph
from meshwright.operators import areas, components, edges, network, spatial
from meshwright.operators.components import connected_components


def sent_whole(df):
    """How many tables a plan broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(50).selectExpr("id", "id * 3.0D AS x", "id * 2.0D AS y")


def test_points_around_aren_t_sent_whole(spark, points):
    """Each point lies in nine cells, which the estimate leaves out."""
    pairs = spatial.radius_join(points, points, 5.0)
    assert not sent_whole(pairs) and pairs.count() == 50 + 2 * 49
    pieces = points.selectExpr("id AS segmento_id", "x AS ax", "y AS ay", "x + 1 AS bx", "y AS by")
    near = spatial.nearest_segment(points, pieces, 5.0)
    assert near.filter("segmento_id = id and distance = 0").count() == 50
    assert sent_whole(near) <= 1  # of these few points, the nearest ones to each


def test_ends_of_the_grid_aren_t_sent_whole(spark, sf_dir):
    assert not sent_whole(fx.grid_road(spark, sf_dir))


def test_edges_of_areas_aren_t_sent_whole(spark, monkeypatch):
    """Squares of a row: those of each ten are one area."""
    sent, keep = [], areas.checkpoint
    monkeypatch.setattr(areas, "checkpoint", lambda df: sent.append(sent_whole(df)) or keep(df))
    point = lambda x, y: f"named_struct('x', CAST(id % 10 + {x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"
    ring = f"array({point(0, 0)}, {point(1, 0)}, {point(1, 1)}, {point(0, 1)}, {point(0, 0)})"
    found = areas.dissolve(spark.range(30).selectExpr("id AS polygon_id", "floor(id / 10) AS k", f"array({ring}) AS rings"), "k")
    assert sent and not any(sent)
    assert sorted((r.k, r.area, len(r.rings), len(r.rings[0])) for r in found.collect()) == [(k, 10.0, 1, 23) for k in range(3)]


def test_rows_are_spread_before_they_multiply(spark, sf_dir):
    assert catalog.QUERIES["pattern_same_street"](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_rows_are_multiplied_last_and_in_blocks(spark, monkeypatch):
    """Two nodes of 50 and 30 neighbours: 5 blocks meet 3 at each; nothing is joined to, or moved after, the rows that they make."""
    monkeypatch.setattr(edges, "BLOCK", 10, raising=False)
    side = lambda n: spark.range(n).selectExpr("id", "concat('n', id) AS name")
    ends = lambda n: spark.range(n).selectExpr("id AS src", "nullif(id % 3, 2) AS dst")
    nodes = {"A": side(150), "B": side(90), "N": side(2)}
    g = PropertyGraph.build(nodes, {"A_IN": (ends(150), "A", "N"), "B_IN": (ends(90), "B", "N")})
    found = g.match().node("a", "A", "name").out("A_IN").node("n", "N", "name").spread().into("B_IN").node("b", "B", "name").rows()
    assert sorted(tuple(r) for r in found.select("a", "b", "n_name", "b_name").collect()) == [
        (a, b, f"n{a % 3}", f"n{b}") for a in range(150) for b in range(90) if a % 3 == b % 3 < 2
    ]
    assert found.rdd.getNumPartitions() == 30
    built = found._jdf.queryExecution().executedPlan().toString()
    assert "_left" in next(line for line in built.splitlines() if "Join" in line)
    empty = g.match().node("a", "A").where("a < 0").out("A_IN").node("n", "N").spread().into("B_IN").node("b", "B").rows()
    assert empty.count() == 0


def test_equal_namesakes_follow_numbers(spark):
    """Of two streets of one name and length the first is that of node 9, not that of node 10."""
    point = lambda x: {"x": float(x), "y": 0.0}
    rows = [(1, 10, 11, 5.0, [point(1000), point(1005)], "A"), (2, 9, 12, 5.0, [point(0), point(5)], "A")]
    segments = spark.createDataFrame(rows, "segmento_id long, u long, v long, largo_m double, line array<struct<x:double,y:double>>, name string")
    _, tagged = network.build_streets(segments)
    assert {r.segmento_id: r.calle_id for r in tagged.collect()} == {2: "a", 1: "a-2"}


def test_tasks_of_crossings_grow_with_pairs(spark, monkeypatch):
    """Each corner has four streets, which are six pairs."""
    monkeypatch.setattr(network, "PAIRS", 100, raising=False)
    members = spark.range(800).selectExpr("floor(id / 4) AS nodo_id", "id % 4 + floor(id / 400) * 4 AS calle_id")
    found = network.crossings(members)
    assert found.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, found.collect())) == [(a + k, b + k, 100) for k in (0, 4) for a in range(4) for b in range(a + 1, 4)]


def test_streets_and_corners_aren_t_sent_whole(spark, sf_dir, monkeypatch):
    """Corners of a narrow table, stars of components and pieces of streets."""
    sent = []
    for module in (components, network):
        monkeypatch.setattr(module, "checkpoint", lambda df, keep=module.checkpoint: sent.append(sent_whole(df)) or keep(df))
    built = network.build_streets
    monkeypatch.setattr(network, "build_streets", lambda segments, *a: sent.append(sent_whole(segments)) or built(segments, *a))
    streets = catalog.QUERIES["street_build"](spark, sf_dir)
    assert len(sent) > 8 and not any(sent) and streets.count() > 0
    assert not sent_whole(catalog._lined(spark, sf_dir))


def test_pieces_that_share_cells_are_compared_once(spark, monkeypatch):
    """Two long pieces side by side share many cells; the first of these compares them, whichever piece begins it."""
    seen, keep = [], network.connected_components
    monkeypatch.setattr(network, "connected_components", lambda df: seen.append(df) or keep(df))
    rows = [("a", "n", 0.0, 0.0, 1000.0, 900.0), ("b", "n", -400.0, 60.0, 1000.0, 960.0), ("c", "n", 0.0, 5000.0, 10.0, 5000.0), ("d", "m", 0.0, 0.0, 10.0, 0.0)]
    found = network.rejoined(spark.createDataFrame(rows, "axis string, name string, ax double, ay double, bx double, by double"), 150.0)
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert "_x0" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_crossings_aren_t_moved(spark, monkeypatch):
    """Pairs are counted where they are made; member 0, which is in all groups, has several tasks. Equal members, nulls and texts are as in a join."""
    monkeypatch.setattr(network, "PAIRS", 300, raising=False)
    rows = [(g, "0") for g in range(300)] + [(g, str(m % 61)) for g in range(300) for m in range(g, g + g % 9)]
    rows += [(7, "0"), (None, "1"), (None, "2"), (5, None)]
    members = spark.createDataFrame(rows, "nodo_id long, calle_id string")
    found = network.crossings(members)
    a, b = members.select("nodo_id", F.col("calle_id").alias("calle_a")), members.select("nodo_id", F.col("calle_id").alias("calle_b"))
    want = a.join(b, "nodo_id").filter("calle_a < calle_b").groupBy("calle_a", "calle_b").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    built = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    made = next(i for i, line in enumerate(built) if "Generate explode(greater" in line)
    assert not any("Exchange" in line or "Shuffle" in line for line in built[:made])
    of_hub = found.filter("calle_a = '0'").groupBy(F.spark_partition_id()).agg(F.sum("esquinas").alias("n")).collect()
    assert len(of_hub) > 2 and max(r.n for r in of_hub) < 600
    assert network.crossings(members.limit(0)).count() == 0


def test_components_read_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return (i, i + 1)

    edges = spark.sparkContext.parallelize(range(30), 3).map(read)
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(31)} and seen.value == 30


def test_points_aren_t_sent_whole_to_cells(spark, monkeypatch):
    """A filter on what was found turns an outer join round, and would send all points; cells go whole only while they are few."""
    points = spark.range(40).selectExpr("id", "id * 30.0D AS x", "id * 20.0D AS y")
    right = spark.range(8).selectExpr("id", "id * 170.0D AS x", "400.0D AS y")
    point = lambda x, y: f"named_struct('x', {x}.0D, 'y', {y}.0D)"
    ring = f"array({point(-5, -5)}, {point(305, -5)}, {point(305, 205)}, {point(-5, 205)}, {point(-5, -5)})"
    zones = spark.range(1).selectExpr("'z' AS polygon_id", f"array({ring}) AS rings")
    inside = areas.holders(points, areas.cover(zones, 16.0), 16.0)
    held = areas.within_join(points, zones, 16.0).filter("polygon_id is not null")
    assert {r.id for r in held.collect()} == {r.id for r in inside.collect()} == set(range(11))
    pieces = points.selectExpr("id AS segmento_id", "x AS ax", "y AS ay", "x + 1 AS bx", "y AS by")
    near = spatial.nearest_segment(points, pieces, 5.0).filter("segmento_id is not null")
    assert near.count() == 40 and not sent_whole(near)
    want = {i: min((((i * 30 - j * 170) ** 2 + (i * 20 - 400) ** 2) ** 0.5, j) for j in range(8)) for i in range(40)}
    for few in (1 << 14, 0):
        monkeypatch.setattr(spatial, "SENT", few, raising=False)
        found = spatial._descended(points, right, 10.0, None)
        built = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in built and (few or "BroadcastExchange" not in built)
        best = spatial._nearest(found).collect()
        assert {r.left_id: (pytest.approx(r.distance), r.right_id) for r in best} == want
    for plan in (held, inside):
        built = plan._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in built
