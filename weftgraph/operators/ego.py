"""Neighbourhoods of some hops around every node, and labels made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.shapes import named, shaped
from weftgraph.sources.views import Graphs

EGO = ["graph_id", "ego"]


def _both(g: Graphs) -> DataFrame:
    e = g.edges.where("src <> dst").select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to"))
    return e.unionByName(e.select("graph_id", F.col("to").alias("node_id"), F.col("node_id").alias("to"))).distinct()


def egos(g: Graphs, radius: int) -> tuple[DataFrame, DataFrame]:
    """members(graph_id, ego, node_id) within so many hops of each node, in either direction, and links(graph_id, ego, node_id, to) among them."""
    both = cut(_both(g))
    members = g.nodes.select("graph_id", F.col("node_id").alias("ego"), "node_id")
    for _ in range(radius):
        more = members.join(both, ["graph_id", "node_id"]).select(*EGO, F.col("to").alias("node_id"))
        members = cut(members.unionByName(more).distinct())
    links = members.join(both, ["graph_id", "node_id"]).join(members.withColumnRenamed("node_id", "to"), [*EGO, "to"]).select(*EGO, "node_id", "to")
    return members, cut(links)


def hashes(g: Graphs, radius: int, rounds: int = 2) -> DataFrame:
    """graph_id, ego, h: a hash of each node's neighbourhood, equal for isomorphic ones.

    Inside each neighbourhood labels start as degrees and are refined so many times by
    those of neighbours; h is over all refined labels of its nodes.
    """
    members, links = egos(g, radius)
    degree = links.groupBy(*EGO, "node_id").agg(F.count("*").cast("string").alias("h"))
    now = members.join(degree, [*EGO, "node_id"], "left").fillna("0", ["h"])
    seen = None
    for _ in range(rounds):
        near = links.join(now.withColumnRenamed("node_id", "to"), [*EGO, "to"]).groupBy(*EGO, "node_id").agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("around"))
        now = cut(now.join(near, [*EGO, "node_id"], "left").select(*EGO, "node_id", F.md5(F.concat_ws("|", "h", F.coalesce("around", F.lit("")))).alias("h")))
        seen = now if seen is None else seen.unionByName(now)
    return seen.groupBy(*EGO).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), ",")).alias("h"))


def relabelled(g: Graphs, radius: int, rounds: int = 2) -> Graphs:
    """g with the number of its neighbourhood's kind as the label of each node: kinds of a graph are numbered from 0 by their least node.

    Labels don't matter to it, so each shape of unlabelled graphs is worked on once.
    """
    s = shaped(g, F.lit(None).cast("string"), black=True)
    h = cut(hashes(s.g, radius, rounds))
    kinds = h.groupBy("graph_id", "h").agg(F.min("ego").alias("least"))
    kinds = kinds.withColumn("kind", F.row_number().over(W.partitionBy("graph_id").orderBy("least")) - 1).drop("least")
    kinds_of = h.join(kinds, ["graph_id", "h"]).select("graph_id", "ego", F.col("kind").cast("string").alias("label"))
    return Graphs(s.spread(kinds_of).select("graph_id", named("ego").alias("node_id"), "label"), g.edges)
