from pyspark.sql import functions as F

from meshwright.operators import network, paths
from meshwright.plans import assemble


def test_small_city(spark):
    lines = {"A": [(0, 0), (100, 0), (200, 0)], "B": [(100, -100), (100, 0), (100, 100)]}
    ways = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in lines.items()], "way_id string, line array<struct<x:double,y:double>>")
    nodes, segments = network.split_ways(ways)
    tagged = segments.withColumns({"name": F.concat(F.lit("Calle "), "way_id"), "highway": F.lit("residential"), "oneway": F.when(F.col("way_id") == "A", "yes")})
    tagged = network.permissions(tagged).withColumns({"sentido": network.oneway(tagged), "ciclovia": network.has_cycleway(tagged)})
    streets, tagged = network.build_streets(tagged, "name")
    places = spark.createDataFrame([("p1", "Bar Uno", "bar", None, 50.0, 10.0), ("p2", None, "pub", "calle b", 20.0, 5.0), ("p3", "", None, None, 900.0, 900.0)], "osm_id string, name string, amenity string, `addr:street` string, x double, y double")
    reports = spark.createDataFrame([("000001", "Ruido", 23, 60.0, 12.0), ("000002", "Robos", None, 101.0, 60.0)], "reporte_id string, categoria string, hora int, x double, y double")
    venues = spark.createDataFrame([("v1", "Pub", 3, 100.0, 90.0)], "venue_id string, category string, checkins int, x double, y double")
    zones = spark.createDataFrame([("z", 5, [[(-10.0, -10.0), (90.0, -10.0), (90.0, 90.0), (-10.0, 90.0), (-10.0, -10.0)]])], "zona_id string, N_PER int, rings array<array<struct<x:double,y:double>>>")
    graph = assemble.build(nodes, tagged, streets, places, reports, venues, zones)
    counts = {r.etiqueta: r.cantidad for r in graph.counts().collect()}
    assert counts == {"Calle": 2, "Interseccion": 5, "Lugar": 3, "Reclamo": 2, "Venue": 1, "ZonaCensal": 1, "CONECTA_AUTO": 6, "CONECTA_BICI": 4, "CONECTA_PEATON": 4, "CRUZA_CON": 1, "EN_CALLE": 11, "EN_ESQUINA": 6, "EN_ZONA": 3, "CERCA_DE": 2}
    kinds = {k: t.rows.count() for k, t in graph.edges.items() if ":" in k}
    assert kinds == {
        "EN_CALLE:Interseccion": 6, "EN_CALLE:Lugar": 2, "EN_CALLE:Reclamo": 2, "EN_CALLE:Venue": 1, "EN_ESQUINA:Lugar": 3,
        "EN_ESQUINA:Reclamo": 2, "EN_ESQUINA:Venue": 1, "EN_ZONA:Lugar": 2, "EN_ZONA:Reclamo": 1, "EN_ZONA:Venue": 0,
    }
    told = {r.src: (r.dst, r.origen, r.distancia_m) for r in graph.edges["EN_CALLE:Lugar"].rows.collect()}
    assert told == {"p1": ("calle-a", "cercania", 10.0), "p2": ("calle-b", "declarada", 80.0)}
    titles = {r.id: (r.categoria, r.etiqueta) for r in graph.nodes["Lugar"].rows.collect()}
    assert titles == {"p1": ("amenity=bar", "Bar Uno"), "p2": ("amenity=pub", "(amenity=pub)"), "p3": ("sin_categoria", "(sin_categoria)")}
    same = graph.match().node("r", "Reclamo").out("EN_CALLE").node("c", "Calle", "nombre").into("EN_CALLE").node("l", "Lugar")
    assert {(r.r, r.l) for r in same.rows().collect()} == {("000001", "p1"), ("000002", "p2")}
    # how a report reaches the streets of places: a repeated group, street - corner - street, with the corners and names in order
    turn = graph.match().node("s", "Calle").into("EN_CALLE").node("x", "Interseccion").out("EN_CALLE").node("m", "Calle", "nombre")
    here = graph.match().node("r", "Reclamo").where("r = '000001'").out("EN_CALLE").node("c", "Calle").rows().select(F.col("c").alias("node"))
    there = graph.match().node("l", "Lugar").where("l = 'p2'").out("EN_CALLE").node("c", "Calle").rows().select(F.col("c").alias("node"))
    route = paths.all_shortest(paths.group(turn.rows(), "s", "m", "x", "m_nombre"), here, there).collect()
    assert [(r.seed, r.target, r.hops, [v.m_nombre for v in r.vias], len({v.x for v in r.vias})) for r in route] == [("calle-a", "calle-b", 1, ["Calle B"], 1)]
