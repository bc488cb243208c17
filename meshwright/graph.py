"""Labelled property graphs as one typed DataFrame for each label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators.edges import block_join, swapped


@dataclass(frozen=True)
class Nodes:
    """The nodes of one label: a column `id` and the properties."""

    rows: DataFrame

    @property
    def properties(self) -> list[str]:
        return [c for c in self.rows.columns if c != "id"]


@dataclass(frozen=True)
class Edges:
    """The edges of one label between two node labels: `src`, `dst` and properties; parallel edges stay apart."""

    rows: DataFrame
    source: str
    target: str
    directed: bool = True

    @property
    def properties(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("src", "dst")]

    def swapped(self) -> DataFrame:
        """The other orientation; a loop has only one."""
        return swapped(self.rows.filter("src != dst"))

    def both_ways(self) -> DataFrame:
        return self.rows.unionByName(self.swapped())


@dataclass(frozen=True)
class PropertyGraph:
    nodes: dict[str, Nodes] = field(default_factory=dict)
    edges: dict[str, Edges] = field(default_factory=dict)

    @staticmethod
    def build(nodes: dict[str, DataFrame], edges: dict[str, tuple]) -> PropertyGraph:
        """From {label: rows} and {label: (rows, source label, target label[, directed])}.

        An edge label with several kinds of ends has a table for each, named label:kind; patterns find all of them by the label.
        """
        return PropertyGraph({k: Nodes(v) for k, v in nodes.items()}, {k: Edges(*v) for k, v in edges.items()})

    def match(self) -> Pattern:
        return Pattern(self)

    def counts(self) -> DataFrame:
        """etiqueta, cantidad, clase of every label: one pass for each table; the kinds of an edge label count together."""
        out = None
        for kind, tables in (("nodo", self.nodes), ("arista", self.edges)):
            for k, t in tables.items():
                counted = t.rows.agg(F.lit(k.split(":")[0]).alias("etiqueta"), F.count("*").alias("cantidad"), F.lit(kind).alias("clase"))
                out = counted if out is None else out.unionByName(counted)
        return out.groupBy("etiqueta", "clase").agg(F.sum("cantidad").alias("cantidad")).select("etiqueta", "cantidad", "clase")

    @property
    def node_count(self) -> int:
        return sum(t.rows.count() for t in self.nodes.values())

    @property
    def edge_count(self) -> int:
        return sum(t.rows.count() for t in self.edges.values())

    def schema(self) -> dict[str, list[str]]:
        return {"node_labels": sorted(self.nodes), "edge_labels": sorted({k.split(":")[0] for k in self.edges})}

    def node_values(self, label: str) -> DataFrame:
        """Whole nodes as values: id and a struct of kind, labels and props; null properties are absent from its JSON."""
        t = self.nodes[label]
        return t.rows.select("id", F.struct(F.lit("node").alias("kind"), F.array(F.lit(label)).alias("labels"), F.struct(*t.properties).alias("props")).alias("node"))


class Pattern:
    """A graph pattern that becomes joins as it is written.

    graph.match().node("r", "Report", "hour").out("ON").node("c", "Street", "name") has columns r, r_hour, c and c_name: a
    variable's column is the node's id. A node table is joined only where properties are named (or the edge doesn't
    fix the label), so ids alone cost no scan. A variable that is bound already closes the pattern on its value.
    """

    def __init__(self, graph: PropertyGraph, rows: DataFrame | None = None, last: str | None = None, label: str | None = None):
        self.graph, self.rows_, self.last, self.label, self.edge, self.spreads = graph, rows, last, label, None, False

    def rows(self) -> DataFrame:
        return self.rows_

    def _with(self, rows: DataFrame, last: str | None = None, label: str | None = None) -> Pattern:
        return Pattern(self.graph, rows, last or self.last, label or self.label)

    def _table(self, var: str, label: str, properties: Sequence[str]) -> DataFrame:
        """Nodes of any of the labels; a property that one of them lacks is null there."""
        out = None
        for one in label.split("|"):
            rows = self.graph.nodes[one].rows
            known = [F.col(p).alias(f"{var}_{p}") for p in properties if p in rows.columns]
            table = rows.select(F.col("id").alias(var), *([F.lit(one).alias(f"{var}_label")] if "|" in label else []), *known)
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
        return out

    @staticmethod
    def _name(var: str, label: str) -> list[str]:
        """The columns that tell a node of a variable: where labels are several, an id alone doesn't."""
        return [var, f"{var}_label"] if "|" in label else [var]

    def node(self, var: str, label: str, *properties: str) -> Pattern:
        """Binds var. label may be "A|B"; then var_label says which it is."""
        if self.edge is None:
            table = self._table(var, label, properties)
            return self._with(table if self.rows_ is None else self.rows_.join(table, self._name(var, label)), var, label)
        table = self._edges(label, var)
        on = self._name(self.last, self.label) + (self._name(var, label) if var in self.rows_.columns else [])
        if self.spreads:
            # properties come before the rows are multiplied
            table = table.join(self._table(var, label, properties), self._name(var, label)) if properties else table
            return self._with(block_join(self.rows_, table, on), var, label)
        rows = self.rows_.join(table, on)
        if properties:
            rows = rows.join(self._table(var, label, properties), self._name(var, label))
        return self._with(rows, var, label)

    def _edges(self, to: str, var: str) -> DataFrame:
        """Edges from the last node to nodes labelled `to`: the columns that tell both, and the edge's properties."""
        labels, direction, edge, properties = self.edge
        wanted, out = labels.split("|") if labels else None, None
        for name, t in self.graph.edges.items():
            label = name.split(":")[0]
            if wanted and label not in wanted and name not in wanted:
                continue
            fits = lambda way: direction == "any" or (direction == way if t.directed else direction == "undirected")  # noqa: E731, B023
            ahead = t.source in self.label.split("|") and t.target in to.split("|") and fits("out")
            back = t.target in self.label.split("|") and t.source in to.split("|") and fits("in")
            # between nodes of one label a loop is met once, though both ways are
            turned = t.swapped() if ahead and back and t.source == t.target else swapped(t.rows)
            for rows, ends in [(t.rows, (t.source, t.target))] * ahead + [(turned, (t.target, t.source))] * back:
                columns = [F.col("src").alias(self.last), F.col("dst").alias(var)]
                columns += [F.lit(ends[0]).alias(f"{self.last}_label")] if "|" in self.label else []
                columns += [F.lit(ends[1]).alias(f"{var}_label")] if "|" in to else []
                columns += [F.col(p).alias(f"{edge}_{p}") for p in properties if p in t.properties]
                columns += [F.lit(label).alias(f"{edge}_label")] if labels is None and edge else []
                out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns), allowMissingColumns=True)
        if out is None:
            raise ValueError(f"no {direction} edge {labels or ''} between {self.label} and {to}")
        return out

    def _step(self, direction: str, labels: str | None, edge: str | None, properties: Sequence[str]) -> Pattern:
        step = self._with(self.rows_)
        step.edge, step.spreads = (labels, direction, edge, properties), self.spreads
        return step

    def out(self, labels: str | None, edge: str | None = None, *properties: str) -> Pattern:
        return self._step("out", labels, edge, properties)

    def into(self, labels: str | None, edge: str | None = None, *properties: str) -> Pattern:
        return self._step("in", labels, edge, properties)

    def undirected(self, labels: str | None, edge: str | None = None, *properties: str) -> Pattern:
        """An undirected edge matches in both orientations."""
        return self._step("undirected", labels, edge, properties)

    def any_way(self, labels: str | None = None, edge: str | None = None, *properties: str) -> Pattern:
        """Any edge, directed or not, either way; without labels, of any label (then edge_label tells which)."""
        return self._step("any", labels, edge, properties)

    def spread(self) -> Pattern:
        """The next step goes from few nodes to many: its rows are made in blocks, which as many tasks as they need share."""
        step = self._with(self.rows_)
        step.spreads = True
        return step

    def where(self, condition: Column | str) -> Pattern:
        return self._with(self.rows_.filter(condition))

    def also(self, other: Pattern) -> Pattern:
        """A second pattern after a comma: joined on the variables that both bind."""
        return self._with(self.rows_.join(other.rows_, self._shared(other)))

    def exists(self, other: Pattern) -> Pattern:
        return self._with(self.rows_.join(other.rows_.select(*self._shared(other)), self._shared(other), "left_semi"))

    def not_exists(self, other: Pattern) -> Pattern:
        return self._with(self.rows_.join(other.rows_.select(*self._shared(other)), self._shared(other), "left_anti"))

    def _shared(self, other: Pattern) -> list[str]:
        shared = [c for c in self.rows_.columns if c in other.rows_.columns]
        if not shared:
            raise ValueError("the patterns share no variable")
        return shared
