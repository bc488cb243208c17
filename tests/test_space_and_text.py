import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from meshwright.functions import geo, text
from meshwright.operators import aggregates, areas, spatial


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id long, x double, y double")


def test_radius_and_nearest(spark):
    rng = random.Random(1)
    a, b = ([(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(n)] for n in (60, 40))
    far = {(i, j): math.dist(p, q) for i, p in enumerate(a) for j, q in enumerate(b)}
    got = {(r.left_id, r.right_id) for r in spatial.radius_join(points(spark, a), points(spark, b), 80.0).collect()}
    assert got == {k for k, d in far.items() if d <= 80}
    near = {r.left_id: r.right_id for r in spatial.nearest_join(points(spark, a), points(spark, b), 20.0).collect()}
    assert near == {i: min(range(40), key=lambda j: (far[i, j], j)) for i in range(60)}
    assert spatial.nearest_join(points(spark, a), points(spark, []), 20.0).count() == 0


def test_chained_tolerance(spark):
    got = {r.id: r.cluster for r in spatial.cluster(points(spark, [(0, 0), (1.4, 0), (2.8, 0), (9, 9)]), 1.5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_within_polygon_with_hole(spark):
    ring = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
    polygons = spark.createDataFrame([(7, [ring(0.0, 10.0), ring(4.0, 6.0)]), (9, [ring(0.0, 20.0)])], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: r.polygon_id for r in areas.within_join(points(spark, [(1, 1), (5, 5), (15, 15), (30, 1), (0, 3)]), polygons, 3.0).collect()}
    assert got == {0: 7, 1: 9, 2: 9, 3: None, 4: None}


def test_measures(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)])], "l array<struct<x:double,y:double>>, r array<struct<x:double,y:double>>")
    row = df.select(geo.line_length(F.col("l")).alias("n"), geo.ring_area(F.col("r")).alias("a"), geo.ring_centroid(F.col("r")).alias("c"), geo.middle_vertex(F.col("l")).alias("m"), geo.wkt_line(F.col("l")).alias("w")).first()
    assert (row.n, row.a, tuple(row.c), tuple(row.m)) == (11.0, 8.0, (2.0, 1.0), (3.0, 4.0)) and row.w == "LINESTRING (0.0 0.0, 3.0 4.0, 3.0 10.0)"


def test_utm(spark):
    row = geo.project_utm(spark.createDataFrame([(-70.65, -33.42)], "lon double, lat double"), "lon", "lat").first()
    assert abs(row.x - 346589.896) < 0.01 and abs(row.y - 6300933.414) < 0.01


def test_slug_equals_python(spark):
    names = ["Avenida Ñuñoa 12", "  --Á é-- ", "", None, "ﬁß øü", "Sant'Ana", "ĀŐ ǅ"]
    want = [re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", n or "").encode("ascii", "ignore").decode().lower()).strip("-") or "sin-nombre" for n in names]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.s for r in df.select("i", text.slug(F.col("n")).alias("s")).orderBy("i").collect()]
    assert [g for k, g in enumerate(got) if k not in (4, 6)] == [w for k, w in enumerate(want) if k not in (4, 6)]


def test_anonymise(spark):
    df = spark.createDataFrame([("escriba a Ñandú.p+x@correo-uno.cl o al +56 9 8765 4321.",), ("patente AB1234 a las 22:30",), (None,)], "t string")
    assert [r[0] for r in df.select(text.anonymise(F.col("t"))).collect()] == ["escriba a [correo] o al [telefono].", "patente AB1234 a las 22:30", None]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 29.9), ("b", 30.0)], "k string, v double")
    assert [tuple(r) for r in aggregates.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert aggregates.value_counts(df, "k", keep_null=True).count() == 3
    assert sorted(tuple(r) for r in aggregates.histogram(df, "v", 0, 30, 30).collect()) == [(1, 1), (2, 1), (29, 1)]
    assert df.select(aggregates.rate(F.lit(3), F.lit(0))).first()[0] is None
    placed = aggregates.positions(spark.range(1000).withColumn("o", F.xxhash64("id")), "o").collect()
    assert [r.position for r in sorted(placed, key=lambda r: r.o)] == list(range(1000))


def test_ascii_of_every_character(spark):
    """What compatibility decomposition and an ASCII encoding leave of each character."""
    import unicodedata

    from meshwright.functions import text

    codes = [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]
    rows = spark.createDataFrame([(i, f"a{chr(i)}b") for i in codes], "i int, t string")
    left = lambda c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
    wrong = [r.i for r in rows.select("i", text.ascii_only(F.col("t")).alias("t")).collect() if r.t != f"a{left(chr(r.i))}b"]
    assert not wrong
    names = spark.createDataFrame([("Phố Hàng Đào", "pho-hang-ao"), ("ĳ ½ ﬁ Ø", "ij-12-fi"), ("!!!", "sin-nombre")], "n string, want string")
    assert all(r.got == r.want for r in names.select("want", text.slug(F.col("n")).alias("got")).collect())


def test_far_points_find_their_nearest(spark):
    """Points far from a dense cluster, beyond it and within, against all pairs."""
    import random

    from meshwright.operators import spatial

    rng = random.Random(5)
    right = [(k, 5000 + rng.random() * 30, 700 + rng.random() * 30) for k in range(300)] + [(900, -4000.0, -90.0), (901, -4000.0, -90.0)]
    left = [(k, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for k in range(80)] + [(100, 5010.0, 710.0), (101, 10.0**6, 0.0)]
    make = lambda rows: spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    far = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    want = {a[0]: min((round(far(a, b), 6), b[0]) for b in right) for a in left}
    got = {r.left_id: (round(r.distance, 6), r.right_id) for r in spatial.nearest_join(make(left), make(right), 5.0).collect()}
    assert got == want
    within = {r.left_id for r in spatial.nearest_join(make(left), make(right), 5.0, 3000.0).collect()}
    assert within == {k for k, (d, _) in want.items() if d <= 3000}
    assert spatial.nearest_join(make(left), make(right).limit(0), 5.0).count() == 0


def test_clip_keeps_the_part_within_the_box(spark):
    rows = [
        (1, 0.0, 0.0, 10.0, 10.0),  # through two corners
        (2, 0.0, 5.0, 20.0, 15.0),  # cut by the left and the upper edge
        (3, 3.0, 3.0, 4.0, 6.0),  # all inside
        (4, 5.0, 5.0, 5.0, 5.0),  # a point
        (5, 0.0, 9.0, 10.0, 14.0),  # passes the corner by
        (6, 8.0, 0.0, 8.0, 8.0),  # along the right edge
        (7, 9.0, 0.0, 9.0, 8.0),  # beside it
        (8, 10.0, 10.0, 0.0, 0.0),  # the other way
    ]
    kept = spatial.clip(spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by double"), 2.0, 2.0, 8.0, 8.0)
    got = {r["id"]: tuple(round(r[c], 6) for c in ("ax", "ay", "bx", "by")) for r in kept.collect()}
    assert got == {
        1: (2, 2, 8, 8),
        2: (2, 6, 6, 8),
        3: (3, 3, 4, 6),
        4: (5, 5, 5, 5),
        6: (8, 2, 8, 8),
        8: (8, 8, 2, 2),
    }


def test_steps_keep_the_last_row_of_each_value(spark):
    rows = spark.createDataFrame([(1.0, 2, "a"), (1.0, 3, "b"), (None, 1, "c"), (0.5, 9, "d"), (None, 4, None)], "v double, t int, x string")
    assert [tuple(r) for r in aggregates.steps(rows, "v", "t").collect()] == [(None, 4, None), (0.5, 9, "d"), (1.0, 3, "b")]
    assert aggregates.steps(rows.limit(0), "v", "t").count() == 0
