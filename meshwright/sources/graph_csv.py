"""Property graphs as a bundle of CSV files, one for each label, with a JSON list of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.text import squeeze
from meshwright.graph import Edges, Nodes, PropertyGraph
from meshwright.operators.edges import swapped
from meshwright.sources.graph_json import identified

#: Names of property types in the list, and the list's name.
TYPES = {"boolean": "BOOL", "int": "INT64", "bigint": "INT64", "smallint": "INT64", "float": "FLOAT64", "double": "FLOAT64"}
_BACK = {"BOOL": "boolean", "INT64": "bigint", "FLOAT64": "double", "STRING": "string"}


CONFIG = "spanner_import_config.json"
#: A quote within a text is doubled, as readers of CSV expect.
_FORMAT = {"header": True, "quote": '"', "escape": '"'}


def _flat(df: DataFrame) -> DataFrame:
    """Text values on one line."""
    return df.select(*(squeeze(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))


def edge_rows(edges: Edges) -> DataFrame:
    """SRC_ID, DST_ID and properties; the format knows directed edges only, so an undirected one is there twice (a loop has one orientation)."""
    rows = edges.rows.withColumns({"src": identified(edges.source, "src"), "dst": identified(edges.target, "dst")})
    if not edges.directed:
        rows = rows.unionByName(swapped(rows.filter("src != dst")))
    return rows.select(F.col("src").alias("SRC_ID"), F.col("dst").alias("DST_ID"), *(F.col(f"`{c}`") for c in edges.properties))


def write_bundle(graph: PropertyGraph, path: str) -> None:
    """A folder of CSV part files for each label, <Label>.csv of nodes and <label>.csv of edges, and CONFIG, which lists them.

    Ids are "<label>:<id>", so that one file holds the edges of a label whatever their ends; properties that an edge lacks are empty.
    Texts are put on one line, their quotes doubled; the format doesn't tell an empty text from a missing one, so both come back as null.
    """
    listed, by_label = [], {}
    columns = lambda df: {c: TYPES.get(kind, "STRING") for c, kind in df.dtypes}
    for label, t in sorted(graph.nodes.items()):
        own = [F.col(f"`{c}`") for c in t.properties]
        rows = _flat(t.rows.select(identified(label, "id").alias("vid"), *own))
        rows.write.options(**_FORMAT).csv(f"{path}/{label}.csv")
        listed.append({"path": f"{label}.csv", "columns": columns(rows)})
    for name, t in graph.edges.items():
        label, rows = name.split(":")[0], _flat(edge_rows(t))
        by_label[label] = rows if label not in by_label else by_label[label].unionByName(rows, allowMissingColumns=True)
    for label, rows in sorted(by_label.items()):
        rows.write.options(**_FORMAT).csv(f"{path}/{label.lower()}.csv")
        listed.append({"path": f"{label.lower()}.csv", "label": label, "columns": columns(rows)})
    spark = next(iter(graph.nodes.values())).rows.sparkSession
    spark.createDataFrame([(json.dumps({"files": listed}, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/{CONFIG}")


def read_bundle(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of a bundle; ids are texts, and all its edges are directed.

    An edge label whose edges join nodes of several labels has a table for each kind of ends, named label:source:target.
    """
    told = json.loads(spark.read.text(f"{path}/{CONFIG}").first()["value"])["files"]

    def read(t: dict) -> DataFrame:
        schema = ", ".join(f"`{c}` {_BACK[k]}" for c, k in t["columns"].items())
        return spark.read.schema(schema).options(**_FORMAT).csv(f"{path}/{t['path']}")

    nodes = {t["path"].removesuffix(".csv"): Nodes(read(t).withColumnRenamed("vid", "id")) for t in told if "label" not in t}
    labels, edges = {label.lower(): label for label in nodes}, {}
    of = lambda c: F.substring_index(c, ":", 1)
    for t in told:
        if "label" not in t:
            continue
        rows = read(t).withColumnsRenamed({"SRC_ID": "src", "DST_ID": "dst"})
        # as many kinds as pairs of labels at most
        kinds = sorted(map(tuple, rows.select(of("src"), of("dst")).distinct().collect()))
        for a, b in kinds:
            name = t["label"] if len(kinds) == 1 else f"{t['label']}:{labels[a]}:{labels[b]}"
            edges[name] = Edges(rows.filter((of("src") == a) & (of("dst") == b)), labels[a], labels[b])
    return PropertyGraph(nodes, edges)


def write_summary(graph: PropertyGraph, path: str) -> None:
    """etiqueta, cantidad, clase of every label as CSV: nodes first, each the most frequent first."""
    order = [F.col("clase").desc(), F.col("cantidad").desc(), "etiqueta"]
    graph.counts().coalesce(1).sortWithinPartitions(*order).write.options(**_FORMAT).csv(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("etiqueta string, cantidad long, clase string").options(**_FORMAT).csv(path)
