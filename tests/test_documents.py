import json
import random
import xml.etree.ElementTree as tree

import pytest

from meshwright.graph import PropertyGraph
from meshwright.sources import graph_json, graphml, json_document, ordered


def random_document(rng, n):
    """Texts with brackets, quotes and backslashes; objects and lists where no elements are; keys named as the lists."""
    texts = ["", "plain", '"', '\\', '\\"', "}", "{", "]},{", '"nodes":[{', "}}\n", "Ñuñoa 😀", '{"id":"x"}', "a" * 300]
    text = lambda: "".join(rng.choice(texts) for _ in range(rng.randint(0, 4)))
    element = lambda i: {"id": f"{i}", "labels": ["L", text()], "props": {text() or "k": text(), "nodes": [{"deep": text()}]}}
    return {
        "meta": {"nodes": [{"no": "element"}], "x": {"y": text()}}, "empty": [], "numbers": [1, 2.5, None, "x}"], "lists": [[{"no": 1}]],
        "nodes": [element(i) for i in range(n)], "odd}key": [element("o")], "one": {"edges": {"no": 1}},
        "edges": [element(-i) | {"endpoints": ["a", text()]} for i in range(n // 2)], "last": text(),
    }


@pytest.mark.parametrize("size", [300, 2000, 1 << 27])
@pytest.mark.parametrize("style", [{"separators": (",", ":")}, {"indent": 1, "ensure_ascii": False}])
def test_elements_of_one_file_in_ranges(spark, tmp_path, size, style):
    """The same elements for one range and for hundreds, on one line or on many."""
    document = random_document(random.Random(size), 40)
    for name, tail in (("a", ""), ("b", "\n")):
        (tmp_path / name).write_text(json.dumps(document, **style) + tail)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            rows = json_document.read_elements(spark, str(tmp_path / name)).collect()
            if size == 300:
                assert json_document._pieces(spark, str(tmp_path / name)).rdd.getNumPartitions() > 50
        finally:
            for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
                spark.conf.unset(f"spark.sql.files.{k}")
        for section in ("nodes", "edges", "odd}key"):
            got = sorted(json.dumps(json.loads(r.value)) for r in rows if r.section == section)
            assert got == sorted(map(json.dumps, document[section])), (section, name)
        assert {r.section for r in rows} == {"nodes", "edges", "odd}key"}


def test_no_elements(spark, tmp_path):
    for name, text in (("x", ""), ("y", "{}"), ("z", '{"nodes":[],"edges":[]}\n')):
        (tmp_path / name).write_text(text)
        assert json_document.read_elements(spark, str(tmp_path / name)).count() == 0


@pytest.fixture(scope="module")
def large(spark):
    street = spark.range(500).selectExpr("id", "concat('Calle \"', id, '\" {[', char(92), '}]') nombre").repartition(7)
    crosses = spark.range(900).selectExpr("id % 500 src", "(id * 7) % 500 dst", "id esquinas").repartition(5)
    return PropertyGraph.build({"Calle": street, "Lugar": spark.range(3).selectExpr("id", "'x' kind")}, {"CRUZA_CON": (crosses, "Calle", "Calle", False)})


def joined(path, names):
    return "".join((path / n).read_text() for n in names)


def test_documents_by_many_writers(spark, large, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = graph_json.write_document(large, str(tmp_path / "j"))
        xml_names = graphml.write(large, str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(names) > 2 and len(xml_names) > 2 and names == ordered.parts(spark, str(tmp_path / "j"))
    told = json.loads(joined(tmp_path / "j", names))
    assert len({n["id"] for n in told["nodes"]}) == 503 and [e["id"] for e in told["edges"]] == [f"a{i}" for i in range(900)]
    root = tree.fromstring(joined(tmp_path / "g", xml_names))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(f"{space}node"))) == 503 and len(list(root.iter(f"{space}edge"))) == 900
    nodes, edges = graph_json.read_document(spark, str(tmp_path / "j"))
    assert {r.id: r.props for r in nodes.collect()} == {n["id"]: n["props"] for n in told["nodes"]}
    assert sorted(tuple(r.endpoints) for r in edges.collect()) == sorted(tuple(e["endpoints"]) for e in told["edges"])
