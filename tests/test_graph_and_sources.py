import csv
import json
import xml.etree.ElementTree as tree
from pathlib import Path

import pytest

from meshwright.graph import PropertyGraph
from meshwright.sources import graph_csv, graph_json, graphml, layers


@pytest.fixture(scope="module")
def graph(spark):
    street = spark.createDataFrame([(1, "Lastra & <Hijos>", 10.5), (2, "Otra\n  calle", float("nan")), (3, "", None)], "id long, nombre string, largo_m double")
    place = spark.createDataFrame([(1, "bar"), (2, "pub")], "id long, kind string")
    on = spark.createDataFrame([(1, 1, 3.0), (2, 1, 4.0), (2, 2, 5.0)], "src long, dst long, m double")
    crosses = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 3, 9)], "src long, dst long, esquinas long")
    return PropertyGraph.build({"Calle": street, "Lugar": place}, {"EN_CALLE": (on, "Lugar", "Calle"), "CRUZA_CON": (crosses, "Calle", "Calle", False)})


def test_patterns(graph):
    m = graph.match
    assert m().node("a", "Lugar").out("EN_CALLE").node("c", "Calle").into("EN_CALLE").node("b", "Lugar").where("a != b").rows().count() == 2
    assert sorted(tuple(r) for r in m().node("a", "Calle").undirected("CRUZA_CON", "e", "esquinas").node("b", "Calle").rows().select("a", "b", "e_esquinas").collect()) == [(1, 2, 1), (2, 1, 1), (2, 3, 2), (3, 2, 2), (3, 3, 9)]
    with_place = m().node("p", "Lugar").out("EN_CALLE").node("c", "Calle")
    assert [r.c for r in m().node("c", "Calle").not_exists(with_place).rows().collect()] == [3]
    assert sorted(r.c for r in m().node("c", "Calle").exists(with_place).rows().collect()) == [1, 2]
    assert m().node("x", "Calle").any_way().node("y", "Calle").rows().count() == 5
    closed = m().node("a", "Calle").undirected("CRUZA_CON").node("b", "Calle").undirected("CRUZA_CON").node("a", "Calle")
    assert closed.rows().count() == 5
    with pytest.raises(ValueError):
        m().node("a", "Lugar").out("CRUZA_CON").node("b", "Calle")
    with pytest.raises(ValueError):
        m().node("a", "Lugar").also(m().node("b", "Calle"))


def test_counts_and_schema(graph):
    assert (graph.node_count, graph.edge_count) == (5, 6) and graph.schema() == {"node_labels": ["Calle", "Lugar"], "edge_labels": ["CRUZA_CON", "EN_CALLE"]}
    value = graph.node_values("Lugar").orderBy("id").first().node
    assert (value.kind, value.labels, value.props.kind) == ("node", ["Lugar"], "bar")


def test_json_documents(spark, graph, tmp_path):
    graph_json.write_document(graph, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in Path(tmp_path / "doc").glob("part-*"))
    told = json.loads(text)
    nodes = {n["id"]: n for n in told["nodes"] if n}
    assert len(nodes) == 5 and nodes["calle:2"]["props"] == {"nombre": "Otra\n  calle"} and nodes["calle:3"]["props"] == {}
    read_nodes, read_edges = graph_json.read_document(spark, str(tmp_path / "doc"))
    assert (read_nodes.count(), read_edges.count(), graph_json.undirected_count(read_edges)) == (5, 6, 3)


def test_csv_writes_undirected_edges_twice(spark, graph, tmp_path):
    graph_csv.write_bundle(graph, str(tmp_path / "bundle"))
    back = graph_csv.read_bundle(spark, str(tmp_path / "bundle"))
    assert back.edge_count == graph.edge_count + 2 and back.node_count == 5  # the loop has one orientation
    assert {r.id: r.nombre for r in back.nodes["Calle"].rows.collect()}["calle:2"] == "Otra calle"


def test_csv_as_other_readers_see_it(spark, tmp_path):
    """Quotes, commas, backslashes and every kind of white space in names."""
    names = ['say "hi", ok', '"', "a\\", '\\"', "a\u00a0b\u2028c\x1cd\x85e\r\nf", "  \tx\u3000 ", "", None, "plain, é"]
    nodes = spark.createDataFrame(list(enumerate(names)), "id long, nombre string").repartition(3)
    edges = spark.createDataFrame([(0, 1, 'x "y", z')], "src long, dst long, tag string")
    graph_csv.write_bundle(PropertyGraph.build({"Calle": nodes}, {"CRUZA_CON": (edges, "Calle", "Calle")}), str(tmp_path / "b"))
    seen = {}
    for part in (tmp_path / "b" / "Calle.csv").glob("part-*"):
        with part.open(newline="", encoding="utf-8") as f:
            seen |= {r["vid"]: r["nombre"] for r in csv.DictReader(f)}
    want = {f"calle:{i}": " ".join((n or "").split()) for i, n in enumerate(names)}
    assert seen == want
    back = graph_csv.read_bundle(spark, str(tmp_path / "b"))
    assert {r.id: r.nombre for r in back.nodes["Calle"].rows.collect()} == {k: v or None for k, v in want.items()}
    assert back.edges["CRUZA_CON"].rows.first().tag == 'x "y", z'


def kinds_of_ends(spark):
    """An edge label whose edges come from nodes of two labels, with other properties each."""
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    nodes = {"Lugar": rows([(1, "bar")], "id long, kind string"), "Reclamo": rows([(1,), (2,)], "id long"), "Calle": rows([(7, "Á")], "id long, nombre string")}
    of_place = (rows([(1, 7, "cercania")], "src long, dst long, origen string"), "Lugar", "Calle")
    return PropertyGraph.build(nodes, {"EN_CALLE:Lugar": of_place, "EN_CALLE:Reclamo": (rows([(1, 7), (2, 7)], "src long, dst long"), "Reclamo", "Calle")})


def test_formats_know_labels_and_not_kinds(spark, tmp_path):
    graph = kinds_of_ends(spark)
    assert {r.etiqueta: r.cantidad for r in graph.counts().collect()} == {"Lugar": 1, "Reclamo": 2, "Calle": 1, "EN_CALLE": 3}
    graph_csv.write_bundle(graph, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["Calle.csv", "Lugar.csv", "Reclamo.csv", "en_calle.csv", "spanner_import_config.json"]
    back = graph_csv.read_bundle(spark, str(tmp_path / "b"))
    assert {k: t.rows.count() for k, t in back.edges.items()} == {"EN_CALLE:Lugar:Calle": 1, "EN_CALLE:Reclamo:Calle": 2}
    graph_json.write_document(graph, str(tmp_path / "j"))
    told = json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part-*")))
    assert [len(told["nodes"]), [e["id"] for e in told["edges"]]] == [4, ["a0", "a1", "a2"]] and {e["labels"][0] for e in told["edges"]} == {"EN_CALLE"}
    empty = PropertyGraph.build({"Calle": graph.nodes["Calle"].rows.limit(0)}, {})
    graph_json.write_document(empty, str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))) == {"nodes": [], "edges": []}
    keys = [r.value for r in graphml.lines(graph).filter("order = 0").orderBy("place").collect()]
    assert sum('id="label"' in k for k in keys) == 2 and sum('attr.name="origen"' in k for k in keys) == 1


def test_patterns_over_several_labels(spark):
    found = kinds_of_ends(spark).match().node("c", "Calle", "nombre").into("EN_CALLE").node("p", "Lugar|Reclamo", "kind").rows().collect()
    assert sorted((r.c, r.p_label, r.p, r.p_kind) for r in found) == [(7, "Lugar", 1, "bar"), (7, "Reclamo", 1, None), (7, "Reclamo", 2, None)]


def test_summary_and_catalogue(spark, graph, tmp_path):
    graph_csv.write_summary(graph, str(tmp_path / "s"))
    assert [tuple(r) for r in graph_csv.read_summary(spark, str(tmp_path / "s")).collect()][:2] == [("Calle", 3, "nodo"), ("Lugar", 2, "nodo")]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "02-ruido.gql").write_text("-- Dónde hay ruido.\n-- Cuenta por calle\n-- y ordena.\nMATCH (a)\nRETURN a\n")
    row = layers.catalogue(spark, str(tmp_path / "q")).first()
    assert tuple(row) == ("02-ruido.gql", "02", "Dónde hay ruido", "Cuenta por calle y ordena.", "MATCH (a)\nRETURN a")


def test_layers_by_geometry_and_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("x", "8", "MultiPolygon"), ("x", "8", "LineString")], "name string, admin_level string, geometry_type string")
    assert layers.boundaries(rows, ["x"]).count() == 1
    layers.write_layer(rows, str(tmp_path / "l"))
    layers.write_layer(rows.limit(1), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    places = spark.createDataFrame([("bar", None), (None, "alcohol"), ("cafe", "shoes")], "amenity string, shop string")
    venues = spark.createDataFrame([("Pub",), ("Home",)], "category string")
    assert tuple(layers.count_kinds(places, venues, ("Pub",)).first()) == (1, 1, 1)


def test_graphml_is_well_formed(graph, tmp_path):
    graphml.write(graph, str(tmp_path / "ml"))
    root = tree.fromstring("".join(p.read_text() for p in Path(tmp_path / "ml").glob("part-*")))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(f"{space}node"))) == 5 and len(list(root.iter(f"{space}edge"))) == 6
    assert sum(e.get("directed") == "false" for e in root.iter(f"{space}edge")) == 3
    assert "Lastra & <Hijos>" in {d.text for d in root.iter(f"{space}data")}
    assert graphml.widened(["bigint", "double"]) == "double" and graphml.widened(["boolean", "int"]) == "string"


def test_layers(spark, tmp_path, monkeypatch):
    layer = layers.Layer("zonas", "zona_id string", optional=True)
    assert layers.read_layer(spark, layer, layers.resolve("zonas", [str(tmp_path)])).count() == 0
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, layers.Layer("vias", "osm_id string"), None)
    monkeypatch.setenv("MESHWRIGHT_ZONAS", "/elsewhere")
    assert layers.resolve("zonas", []) == "/elsewhere"
    places = spark.createDataFrame([(None, "bench"), ("Mi banco", "bench"), (None, "bar"), (None, None)], "name string, amenity string")
    assert layers.admitted_places(places).count() == 3
    edges = spark.createDataFrame([("8", "Ñuñoa"), ("4", "Maipú")], "admin_level string, name string")
    assert layers.boundaries(edges, ["Ñuñoa"]).count() == 1
    with pytest.raises(ValueError):
        layers.boundaries(edges, ["Maipú"])
    assert layers.zones_of(spark.createDataFrame([("NUNOA",), ("MAIPU",)], "COMUNA string"), "COMUNA", ["Ñuñoa"]).count() == 1
    assert layers.split_header("-- Title\n-- more\n\nMATCH (n)\n-- not a header") == (["Title", "more"], "MATCH (n)\n-- not a header")
