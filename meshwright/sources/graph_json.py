"""Property graphs as JSON text: {"nodes": [...], "edges": [...]}, one element a line between the frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.graph import Edges, PropertyGraph
from meshwright.operators.aggregates import numbered
from meshwright.sources.json_document import read_elements
from meshwright.sources.ordered import write_parts


def _props(names: list[str], kinds: dict[str, str]) -> Column:
    """Properties as a struct; null, not-a-number, infinite and empty values are absent from its JSON."""
    def value(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
        return (F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)).alias(c)

    return F.struct(*map(value, names)) if names else F.from_json(F.lit("{}"), "struct<_:string>")


def numbered_edges(graph: PropertyGraph) -> Iterator[tuple[str, Edges, DataFrame]]:
    """(label, edges, rows with _number) of each table; numbers go on from one table to the next."""
    before = 0
    for name, t in graph.edges.items():
        rows = numbered(t.rows, "_number")
        n = rows.count()
        yield name.split(":")[0], t, rows.withColumn("_number", F.col("_number") + before)
        before += n


def identified(label: str, column: str) -> Column:
    """A node's id in every format: its label in small letters, a colon, its id there."""
    return F.concat(F.lit(label.lower() + ":"), F.col(column).cast("string"))


def _lines(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as columns `value`, compact JSON objects, and `number`, from 0 each; edges are a0, a1 and so on."""
    nodes = edges = None
    before = 0
    for label, t in graph.nodes.items():
        rows = numbered(t.rows, "_number")
        props = _props(t.properties, dict(t.rows.dtypes)).alias("props")
        element = F.struct(identified(label, "id").alias("id"), F.array(F.lit(label)).alias("labels"), props)
        lines = rows.select(F.to_json(element).alias("value"), (F.col("_number") + before).alias("number"))
        nodes = lines if nodes is None else nodes.unionByName(lines)
        before += rows.count()
    for label, t, rows in numbered_edges(graph):
        element = F.struct(
            F.concat(F.lit("a"), F.col("_number").cast("string")).alias("id"),
            F.array(F.lit(label)).alias("labels"),
            F.array(identified(t.source, "src"), identified(t.target, "dst")).alias("endpoints"),
            F.lit("->" if t.directed else "~~").alias("directionality"),
            _props(t.properties, dict(t.rows.dtypes)).alias("props"),
        )
        lines = rows.select(F.to_json(element).alias("value"), F.col("_number").alias("number"))
        edges = lines if edges is None else edges.unionByName(lines)
    return nodes, edges


def write_lines(graph: PropertyGraph, path: str) -> None:
    """The elements as JSON lines, in parallel: <path>/nodes and <path>/edges."""
    for name, lines in zip(("nodes", "edges"), _lines(graph)):
        if lines is not None:
            lines.select("value").write.text(f"{path}/{name}")


def write_document(graph: PropertyGraph, path: str) -> list[str]:
    """One JSON document as numbered text parts in `path`, written by many tasks; joined in the order of the names returned, they are the document."""
    nodes, edges = _lines(graph)
    spark = nodes.sparkSession
    whole = spark.createDataFrame([('{"nodes":[', 0), ('],"edges":[', 2), ("]}", 4)], "value string, part int").withColumn("number", F.lit(0).cast("long"))
    for lines, part in ((nodes, 1), (edges, 3)):
        if lines is not None:
            comma = F.when(F.col("number") > 0, ",").otherwise("")
            whole = whole.unionByName(lines.select(F.concat(comma, "value").alias("value"), F.lit(part).alias("part"), "number"))
    return write_parts(whole, ["part", "number"], path)


_NODE = "struct<id:string,labels:array<string>,props:map<string,string>>"
_EDGE = "struct<id:string,labels:array<string>,endpoints:array<string>,directionality:string,props:map<string,string>>"


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document: id, labels, props and id, labels, endpoints, directionality, props as text values.

    It may lie in one line of one file or in parts; it is read in byte ranges, of which no task sees all (see json_document).
    """
    found = read_elements(spark, path)
    of = lambda section, kind: found.filter(F.col("section") == section).select(F.from_json("value", kind).alias("e")).select("e.*")
    return of("nodes", _NODE), of("edges", _EDGE)


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of JSON lines."""
    return tuple(spark.read.text(f"{path}/{name}").select(F.from_json("value", kind).alias("e")).select("e.*") for name, kind in (("nodes", _NODE), ("edges", _EDGE)))


def undirected_count(edges: DataFrame) -> int:
    return edges.filter("directionality = '~~'").count()
