"""GraphML, written line by line in parallel as parts that joined in order are one file."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.text import xml_escaped
from meshwright.graph import PropertyGraph
from meshwright.sources.graph_json import identified, numbered_edges
from meshwright.sources.ordered import write_parts

#: GraphML's names of types.
TYPES = {"boolean": "boolean", "int": "long", "bigint": "long", "smallint": "long", "float": "double", "double": "double"}


def _data(df: DataFrame, names: list[str]) -> list[Column]:
    """<data> elements of the values that are there: not null, empty, infinite or not a number."""
    kinds, out = dict(df.dtypes), []
    for c in names:
        value = F.col(f"`{c}`").cast("string")
        there = value.isNotNull() & (value != "")
        if kinds[c] in ("double", "float"):
            there = there & ~value.isin("NaN", "Infinity", "-Infinity")
        text = xml_escaped(value) if kinds[c] == "string" else value
        out.append(F.when(there, F.concat(F.lit(f'<data key="{escape(c)}">'), text, F.lit("</data>"))))
    return out


def widened(kinds: list[str]) -> str:
    """One type for a key's types over all labels: numbers widen to double, other mixtures are text."""
    found = {TYPES.get(k, "string") for k in kinds}
    return found.pop() if len(found) == 1 else "double" if found == {"long", "double"} else "string"


#: The head of a file.
HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
    'xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">',
]


def _keys(tables: Iterable, scope: str) -> list[str]:
    """A declaration for each property that elements of a scope have, the label first."""
    kinds: dict[str, list[str]] = {"label": ["string"]}
    for t in tables:
        for c in t.properties:
            kinds.setdefault(c, []).append(dict(t.rows.dtypes)[c])
    names = {c: escape(c) for c in kinds}
    return [f'<key id="{names[c]}" for="{scope}" attr.name="{names[c]}" attr.type="{widened(k)}"/>' for c, k in kinds.items()]


def lines(graph: PropertyGraph, directed: bool = True) -> DataFrame:
    """value and order: head and keys 0, nodes 1, edges 2, tail 3. Edges are e0, e1 and so on."""
    spark = next(iter(graph.nodes.values())).rows.sparkSession
    head = HEAD + _keys(graph.nodes.values(), "node") + _keys(graph.edges.values(), "edge")
    head.append(f'<graph id="G" edgedefault="{"directed" if directed else "undirected"}">')
    framed = [(text, 0, k) for k, text in enumerate(head)] + [("</graph>", 3, 0), ("</graphml>", 3, 1)]
    out = spark.createDataFrame(framed, "value string, order int, place long")
    name = lambda label, c: xml_escaped(identified(label, c))
    for label, t in graph.nodes.items():
        opened = F.concat(F.lit('<node id="'), name(label, "id"), F.lit(f'"><data key="label">{label}</data>'))
        text = F.concat(opened, F.concat_ws("", *_data(t.rows, t.properties)), F.lit("</node>"))
        out = out.unionByName(t.rows.select(text.alias("value"), F.lit(1).alias("order"), F.xxhash64(F.lit(label), "id").alias("place")))
    for label, t, rows in numbered_edges(graph):
        own = "" if t.directed == directed else f' directed="{str(t.directed).lower()}"'
        ends = [F.lit('" source="'), name(t.source, "src"), F.lit('" target="'), name(t.target, "dst")]
        opened = F.concat(F.lit('<edge id="e'), F.col("_number").cast("string"), *ends, F.lit(f'"{own}><data key="label">{label}</data>'))
        text = F.concat(opened, F.concat_ws("", *_data(t.rows, t.properties)), F.lit("</edge>"))
        out = out.unionByName(rows.select(text.alias("value"), F.lit(2).alias("order"), F.col("_number").alias("place")))
    return out


def write(graph: PropertyGraph, path: str, directed: bool = True) -> list[str]:
    """The graph as numbered text parts in the folder `path`, written by many tasks; joined in the order of the names returned, they are one file."""
    return write_parts(lines(graph, directed), ["order", "place"], path)


def write_modes(graph: PropertyGraph, path: str, modes: dict[str, str], nodes: str) -> None:
    """One file for each mode: {file name: edge label} over the nodes of one label."""
    for name, label in modes.items():
        write(PropertyGraph({nodes: graph.nodes[nodes]}, {label: graph.edges[label]}), f"{path}/{name}", graph.edges[label].directed)
