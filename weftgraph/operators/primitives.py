"""Filters, projections and structural tests on graph collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.sources.views import Graphs, dealt


def induced(g: Graphs, chosen: DataFrame) -> Graphs:
    """The subgraph on chosen(graph_id, node_id): its nodes, and edges with both ends among them."""
    ends = chosen.select("graph_id", "node_id")
    src, dst = (ends.withColumnRenamed("node_id", c) for c in ("src", "dst"))
    return Graphs(g.nodes.join(ends, ["graph_id", "node_id"], "left_semi"), g.edges.join(src, ["graph_id", "src"], "left_semi").join(dst, ["graph_id", "dst"], "left_semi"))


def neighbours(g: Graphs, chosen: DataFrame, direction: str = "both") -> DataFrame:
    """graph_id, node_id of the distinct neighbours of a node set, outside it. direction: in, out or both."""
    out = g.edges.select("graph_id", F.col("src").alias("at"), F.col("dst").alias("node_id"))
    into = g.edges.select("graph_id", F.col("dst").alias("at"), F.col("src").alias("node_id"))
    pairs = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    near = pairs.join(chosen.select("graph_id", F.col("node_id").alias("at")), ["graph_id", "at"], "left_semi").select("graph_id", "node_id").distinct()
    return near.join(chosen.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


def labelled(g: Graphs, labels: list[str]) -> DataFrame:
    """Nodes whose label is one of labels."""
    return g.nodes.where(F.col("label").isin(labels))


def first_by_label(g: Graphs, label: str) -> DataFrame:
    """graph_id, node_id of each graph's first node with the label."""
    return g.nodes.where(F.col("label") == label).groupBy("graph_id").agg(F.min("node_id").alias("node_id"))


def with_labels(g: Graphs) -> DataFrame:
    """Edges with the labels of both ends, as src_label and dst_label."""
    own = g.nodes.select("graph_id", "node_id", "label")
    e = g.edges.join(own.select("graph_id", F.col("node_id").alias("src"), F.col("label").alias("src_label")), ["graph_id", "src"])
    return e.join(own.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("dst_label")), ["graph_id", "dst"]).select("graph_id", "src", "dst", "label", "src_label", "dst_label")


def boundary(g: Graphs, nonterminals: list[str]) -> DataFrame:
    """graph_id of graphs with an edge between two nonterminals."""
    nts = labelled(g, nonterminals).select("graph_id", "node_id")
    e = g.edges.join(nts.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(nts.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    return e.select("graph_id").distinct()


def statistics(g: Graphs, nonterminals: list[str], source: str, sink: str) -> DataFrame:
    """For each graph: n_nodes, n_edges, n_terms, all_nonterminal, one_source_and_sink, source_xor_sink."""
    is_nt = F.col("label").isin(nonterminals)
    ends = F.count_if(F.col("label").isin(source, sink))
    nodes = g.nodes.groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(~is_nt).alias("n_terms"),
        F.every(is_nt).alias("all_nonterminal"),
        ((F.count_if(F.col("label") == source) == 1) & (F.count_if(F.col("label") == sink) == 1)).alias("one_source_and_sink"),
        (ends == 1).alias("source_xor_sink"),
    )
    return nodes.join(g.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id", "left").fillna(0, ["n_edges"])


def without_ends(g: Graphs, labels: list[str], at_most: int | None = None) -> Graphs:
    """g without nodes of the labels and their edges; of at_most graphs, those of the least ids."""
    kept = g.nodes.where(~F.col("label").isin(labels))
    if at_most is not None:
        kept = kept.join(kept.select("graph_id").distinct().orderBy("graph_id").limit(at_most), "graph_id", "left_semi")
    return Graphs(kept, induced(g, kept).edges)


def partition(g: Graphs, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of size nodes with a halo of their neighbours, and the edges of each block without those inside the halo.

    blocks: graph_id, block, node_id, halo; edges: graph_id, block, src, dst, label.
    """
    nth = F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1
    own = g.nodes.select("graph_id", F.floor(nth / size).alias("block"), "node_id")
    at = own.withColumnsRenamed({"node_id": "src", "block": "block_a"})
    to = own.withColumnsRenamed({"node_id": "dst", "block": "block_b"})
    e = g.edges.join(at, ["graph_id", "src"]).join(to, ["graph_id", "dst"])
    split = F.when(F.col("block_a") == F.col("block_b"), F.array("block_a")).otherwise(F.array("block_a", "block_b"))
    edges = e.withColumn("block", F.explode(split))
    halo = edges.select("graph_id", "block", F.when(F.col("block_a") == F.col("block"), F.struct(F.col("dst").alias("n"), F.col("block_b").alias("b"))).otherwise(F.struct(F.col("src").alias("n"), F.col("block_a").alias("b"))).alias("o"))
    halo = halo.where("o.b <> block").select("graph_id", "block", F.col("o.n").alias("node_id"), F.lit(True).alias("halo")).distinct()
    return own.withColumn("halo", F.lit(False)).unionByName(halo), edges.select("graph_id", "block", "src", "dst", "label")


def without(g: Graphs, gone: DataFrame) -> Graphs:
    """g without the nodes gone(graph_id, node_id) and all their edges."""
    ids = gone.select("graph_id", "node_id")
    edges = g.edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_anti").join(ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti")
    return Graphs(g.nodes.join(ids, ["graph_id", "node_id"], "left_anti"), edges)


def line_graph(bonds: DataFrame) -> DataFrame:
    """mol, a, b: pairs of bonds(mol, bond, atoms) that share an atom."""
    at = bonds.select("mol", "bond", F.explode("atoms").alias("atom"))
    pairs = at.withColumnRenamed("bond", "a").join(at.withColumnRenamed("bond", "b"), ["mol", "atom"]).where("a < b")
    return pairs.select("mol", "a", "b").distinct()


def clique_graph(bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """The line graph with all pairs of bonds of a ring as well; rings(mol, ring, bond).

    A mol's bonds are gathered in a row and paired there, each with those after it, so that pairs
    are neither shuffled nor held to be told apart.
    """
    at = bonds.select("mol", "bond", "atoms", F.lit(None).cast(rings.schema["ring"].dataType).alias("ring"))
    held = at.unionByName(rings.select("mol", "bond", F.lit(None).cast(bonds.schema["atoms"].dataType).alias("atoms"), "ring"))
    rows = dealt(held.where("mol IS NOT NULL AND bond IS NOT NULL"), "mol").groupBy("mol").agg(F.collect_list(F.struct("bond", "atoms", "ring")).alias("all"))
    each = rows.select("mol", "all", F.explode(F.array_distinct("all.bond")).alias("a"))
    mine = F.filter("all", lambda x: x["bond"] == F.col("a"))
    own = F.flatten(F.filter(F.transform(mine, lambda x: x["atoms"]), lambda x: x.isNotNull()))
    near = F.filter("all", lambda x: (x["bond"] > F.col("a")) & (F.coalesce(F.arrays_overlap(x["atoms"], F.col("own")), F.lit(False)) | F.coalesce(F.array_contains("rings", x["ring"]), F.lit(False))))
    each = each.withColumns({"own": own, "rings": F.array_compact(F.transform(mine, lambda x: x["ring"]))})
    return each.select("mol", "a", F.explode(F.array_distinct(F.transform(near, lambda x: x["bond"]))).alias("b"))
