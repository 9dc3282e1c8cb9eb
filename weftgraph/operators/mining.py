"""Frequent connected motifs of a collection, grown node by node as joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.shapes import shaped, small
from weftgraph.sources.views import Graphs


def code(labels: list[str], edges: list[tuple[int, int, str]]) -> str:
    """The least string of a small labelled directed graph over all orders of its nodes that sort the labels; isomorphic graphs share it, others don't."""
    classes = [[k for k, x in enumerate(labels) if x == label] for label in sorted(set(labels))]
    best = None
    for order in product(*map(permutations, classes)):
        at = {n: k for k, n in enumerate(n for part in order for n in part)}
        text = ";".join(sorted(f"{at[a]}>{at[b]}:{x}" for a, b, x in edges))
        best = text if best is None else min(best, text)
    return ";".join(sorted(labels)) + "/" + (best or "")


def _codes(forms: DataFrame) -> DataFrame:
    """form, code of distinct forms(form, labels, es)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [code(list(labels), [(e["a"], e["b"], e["x"]) for e in es]) for labels, es in zip(pdf.labels, pdf.es, strict=True)]
            yield pd.DataFrame({"form": pdf.form, "code": found})

    return forms.mapInPandas(run, "form string, code string")


def _formed(sets: DataFrame) -> DataFrame:
    """sets with labels, es (edges by place) and form: equal for equal labels and edges in the order of the nodes."""
    nodes = F.transform("members", lambda m: m["node"])
    place = lambda n: (F.array_position("nodes", n) - 1).cast("int")
    sets = sets.withColumn("nodes", nodes).withColumn("labels", F.transform("members", lambda m: m["label"]))
    sets = sets.withColumn("es", F.array_sort(F.transform("inside", lambda e: F.struct(place(e["src"]).alias("a"), place(e["dst"]).alias("b"), e["label"].alias("x")))))
    return sets.withColumn("form", F.to_json(F.struct("labels", "es")))


def _first(g: Graphs) -> DataFrame:
    """graph_id, members, inside of all sets of one node."""
    none = F.array().cast("array<struct<src:" + dict(g.edges.dtypes)["src"] + ",dst:" + dict(g.edges.dtypes)["src"] + ",label:string>>")
    return g.nodes.select("graph_id", F.array(F.struct(F.col("node_id").alias("node"), F.coalesce("label", F.lit("#")).alias("label"))).alias("members"), none.alias("inside"))


def _steps(g: Graphs) -> DataFrame:
    """graph_id, a, b, b_label, own (edges between the two): every joined pair, from both ends."""
    e = g.edges.where("src <> dst").select("graph_id", "src", "dst", F.coalesce("label", F.lit("")).alias("label"))
    own = F.struct("src", "dst", "label").alias("e")
    pairs = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), own).unionByName(e.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"), own))
    pairs = pairs.groupBy("graph_id", "a", "b").agg(F.collect_set("e").alias("own"))
    return pairs.join(g.nodes.select("graph_id", F.col("node_id").alias("b"), F.coalesce("label", F.lit("#")).alias("b_label")), ["graph_id", "b"])


def _grown(sets: DataFrame, steps: DataFrame) -> DataFrame:
    """Connected sets with one node more, each once, with all edges inside.

    A set is reached from each of its parts; what each row says of its edges is
    joined when the rows meet, so the edges of a set are whole without another join.
    """
    at = sets.select("graph_id", "members", "inside", F.explode(F.transform("members", lambda m: m["node"])).alias("a"))
    more = at.join(steps, ["graph_id", "a"]).where(~F.exists("members", lambda m: m["node"] == F.col("b")))
    more = more.select("graph_id", F.array_sort(F.array_append("members", F.struct(F.col("b").alias("node"), F.col("b_label").alias("label")))).alias("members"), F.concat("inside", "own").alias("inside"))
    return more.groupBy("graph_id", "members").agg(F.array_distinct(F.flatten(F.collect_set("inside"))).alias("inside"))


def embeddings(g: Graphs, most: int = 5, least: int = 2, often: DataFrame | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(k, rows graph_id, nodes, es, code) for k = 1 to most: connected induced sets of k nodes whose code at least so many graphs hold.

    A motif of k nodes that enough graphs hold has a connected part of k - 1 nodes that they
    hold as well, so only sets whose code is frequent are grown. Codes are made once
    for each distinct form, not for each set. Loops are left out; a missing label is "#".
    With often(graph_id, often), a graph counts as so many.
    """
    steps = cut(_steps(g))
    sets = _first(g)
    for k in range(1, most + 1):
        formed = cut(_formed(sets))
        forms = cut(_codes(formed.groupBy("form").agg(F.first("labels").alias("labels"), F.first("es").alias("es"))))
        coded = formed.join(small(forms), "form")
        holds = coded.select("code", "graph_id").distinct()
        holds = holds.withColumn("often", F.lit(1)) if often is None else holds.join(often, "graph_id")
        frequent = cut(holds.groupBy("code").agg(F.sum("often").alias("n")).where(F.col("n") >= least).select("code"))
        kept = cut(coded.join(small(frequent), "code"))
        yield k, kept.select("graph_id", "nodes", "es", "code")
        if k < most:
            if kept.isEmpty():
                return
            sets = _grown(kept.select("graph_id", "members", "inside"), steps)


def mine(g: Graphs, most: int = 5, least: int = 2, from_nodes: int = 2) -> DataFrame:
    """code, n_nodes, n_edges, n_matches, n_graphs, gain, graph_id, nodes: frequent motifs, each with its first occurrence.

    n_matches counts the node sets that induce the motif. gain is what it saves where
    each graph that holds it replaces one occurrence by a node, less the motif's own
    size: n_graphs * (n_nodes - 1 + n_edges) - (n_nodes + n_edges). Sets are grown in one graph of each
    shape, which counts as often as there are graphs of it and is the least of them.
    """
    s, out = shaped(g), None
    often, ids = s.firsts.select("graph_id", "often"), s.firsts.select("graph_id", "ids")
    for k, rows in embeddings(s.g, most, least, often):
        found = rows.groupBy("code", "graph_id").agg(F.first(F.size("es")).alias("m"), F.count("*").alias("sets"), F.min("nodes").alias("places"))
        found = found.join(often, "graph_id").join(ids, "graph_id").withColumn("nodes", F.transform("places", lambda p: F.get("ids", p - 1)))
        found = found.groupBy("code").agg(F.first("m").alias("n_edges"), F.sum(F.col("sets") * F.col("often")).alias("n_matches"), F.sum("often").alias("n_graphs"), F.min(F.struct("graph_id", "nodes")).alias("at"))
        found = found.select("code", F.lit(k).alias("n_nodes"), "n_edges", "n_matches", "n_graphs", (F.col("n_graphs") * (k - 1 + F.col("n_edges")) - (k + F.col("n_edges"))).alias("gain"), "at.graph_id", "at.nodes")
        out = found if out is None else out.unionByName(found)
    return out.where(F.col("n_nodes") >= from_nodes)


def top(motifs: DataFrame, k: int) -> DataFrame:
    """The k motifs of the greatest gain; ties by code."""
    return motifs.orderBy(F.desc("gain"), "code").limit(k)
