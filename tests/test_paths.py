import random

from meshwright.operators import paths
from meshwright.operators.components import connected_components


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, w double")


def test_cap_comes_after_the_choice(spark):
    e = paths.both_ways(edges(spark, [("S", "P", 700.0), ("P", "D", 10.0), ("S", "a", 10.0), ("a", "b", 10.0), ("b", "D", 10.0)]))
    got = {r.node for r in paths.any_shortest(e, edges(spark, [("S", "", 0.0)]).selectExpr("src AS node"), weight="w", cap=600.0).collect()}
    assert got == {"S", "a", "b"}


def test_two_by_two_block(spark):
    e = paths.both_ways(edges(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("B", "D", 1.0), ("C", "D", 1.0)]))
    at = lambda n: spark.createDataFrame([(n,)], "node string")
    assert sorted(r.path for r in paths.all_shortest(e, at("A"), at("D")).collect()) == [["A", "B", "D"], ["A", "C", "D"]]
    one = paths.any_shortest(e, at("A"), at("D")).collect()
    assert [(r.node, r.hops) for r in one] == [("D", 2)]


def test_zero_or_more_and_one_or_more(spark):
    e = paths.both_ways(edges(spark, [("A", "B", 5.0)]))
    seed = spark.createDataFrame([("A",)], "node string")
    assert {(r.node, r.total) for r in paths.any_shortest(e, seed, weight="w").collect()} == {("A", 0.0), ("B", 5.0)}
    assert {(r.node, r.hops, r.total) for r in paths.any_shortest(e, seed, weight="w", least_hops=1).collect()} == {("B", 1, 5.0), ("A", 2, 10.0)}
    lonely = spark.createDataFrame([("Z",)], "node string")
    assert [r.node for r in paths.any_shortest(e, lonely).collect()] == ["Z"]


def test_isochrone_takes_the_shortest_in_metres(spark):
    e = edges(spark, [("S", "D", 100.0), ("S", "a", 10.0), ("a", "D", 10.0), ("D", "E", 5.0)])
    got = {(r.node, r.total) for r in paths.isochrone(e, spark.createDataFrame([("S",)], "node string"), "w", 22.0).collect()}
    assert got == {("S", 0.0), ("a", 10.0), ("D", 20.0)}
    kept = paths.reachable_segments(e.selectExpr("src AS u", "dst AS v", "w"), spark.createDataFrame([("S",), ("a",), ("D",)], "node string"))
    assert kept.count() == 3


def test_hops_to_nearest(spark):
    e = paths.both_ways(edges(spark, [(str(i), str(i + 1), 1.0) for i in range(20)]))
    got = {r.node: r.hops for r in paths.hops_to_nearest(e, spark.createDataFrame([("0",), ("20",)], "node string")).collect()}
    assert got == {str(i): min(i, 20 - i) for i in range(21)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1030)] + [(5000, 5000), (None, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        else:
            find(b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()))
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
