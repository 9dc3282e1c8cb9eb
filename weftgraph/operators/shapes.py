"""Graphs of one shape as one: what follows from the order of the nodes, their labels and the edges is found once for each shape.

Collections of small graphs hold few shapes beside their graphs. A shape is a graph with its nodes
numbered by their order, so whatever compares nodes comes out alike in all graphs of a shape. Where nearly all graphs differ,
there are as many shapes as graphs, and all is as much work as before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut, kept
from weftgraph.sources.views import Graphs

#: Rows that are broadcast, at most; more are joined by a shuffle.
FEW = 50_000
KEY = ["cells", "links"]


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


@dataclass(frozen=True)
class Shapes:
    """of(graph_id, ids, labels, cells, links): the graphs. firsts(cells, links, graph_id, ids, often): the shapes, each by its least graph. g: the shapes as graphs, nodes by place from 1."""

    of: DataFrame
    firsts: DataFrame
    g: Graphs

    def rows(self, found: DataFrame) -> DataFrame:
        """of joined to found(graph_id, ...) of the shapes; graphs whose shape has no row give none."""
        return self.of.join(small(cut(self.firsts.select(*KEY, F.col("graph_id").alias("_first")).join(found.withColumnRenamed("graph_id", "_first"), "_first").drop("_first"))), KEY)

    def spread(self, found: DataFrame) -> DataFrame:
        """graph_id, ids and the other columns of found(graph_id, ...) for each graph: the rows of its shape, which are about as many as its nodes and travel as one."""
        names = [c for c in found.columns if c != "graph_id"]
        packs = found.groupBy("graph_id").agg(F.collect_list(F.struct(*names)).alias("_rows"))
        return self.rows(packs).select("graph_id", "ids", F.inline("_rows"))


def named(place: str | Column) -> Column:
    """The node at a place of `ids`; null for none."""
    return F.get("ids", F.col(place) - 1 if isinstance(place, str) else place - 1)


def shaped(g: Graphs, label: Column | None = None, black: bool = False) -> Shapes:
    """The shapes of g's graphs with label, of its nodes, in place of their labels; black: without labels of edges.

    The graphs are laid out once, a row each, and all else reads them there. `labels` has the own label
    of each cell. Edges of graphs without nodes are left out.
    """
    own = F.col("label").cast("string")
    nodes = g.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", (own if label is None else label).alias("x"), own.alias("own")))).alias("n"))
    edges = g.edges.select("graph_id", "src", "dst", (F.lit(None).cast("string") if black else own).alias("label"))
    edges = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "label")).alias("e"))
    both = nodes.join(edges, "graph_id", "left").withColumn("e", F.coalesce("e", F.array().cast(edges.schema["e"].dataType)))
    ids = F.array_sort(F.array_compact(F.array_distinct(F.concat("n.node_id", "e.src", "e.dst"))))
    place = lambda x: F.array_position("ids", x).cast("int")
    cells = F.transform("n", lambda n: F.struct(place(n["node_id"]).alias("place"), n["x"].alias("label")))
    links = F.array_sort(F.transform("e", lambda e: F.struct(place(e["src"]).alias("src"), place(e["dst"]).alias("dst"), e["label"].alias("label"))))
    of = kept(both.withColumn("ids", ids).select("graph_id", "ids", F.col("n.own").alias("labels"), cells.alias("cells"), links.alias("links")))
    firsts = cut(of.groupBy(*KEY).agg(F.min(F.struct("graph_id", "ids")).alias("f"), F.count("*").alias("often")).select(*KEY, "f.graph_id", "f.ids", "often"))
    return Shapes(of, firsts, Graphs(
        firsts.select("graph_id", F.inline("cells")).select("graph_id", F.col("place").alias("node_id"), "label"),
        firsts.select("graph_id", F.inline("links")),
    ))
