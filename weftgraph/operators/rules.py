"""Rule tables: looking rules up, adding new ones, and following a derivation's tree.

A rule table is rules(rule_id, symbol, form, embedding, upper): the canonical form of the
right-hand side, and two sets of instructions as arrays. Rules are the same if the form
and both sets are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.identifiers import set_key
from weftgraph.operators.matching import Pattern, match
from weftgraph.operators.shapes import small
from weftgraph.operators.traversal import closure
from weftgraph.sources.views import Graphs

KEYS = ["form", "embedding", "upper"]


def keyed(rules: DataFrame) -> DataFrame:
    """rules with both sets in order and without repeats, so that they can be compared."""
    return rules.withColumns({c: set_key(F.col(c)) for c in KEYS[1:]})


def lookup(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id, rule_id: for each of asked(ask_id, form, embedding, upper) the least id of the same rule; null if there is none."""
    known = keyed(rules).groupBy(*KEYS).agg(F.min("rule_id").alias("rule_id"))
    return keyed(asked).join(known, KEYS, "left").select("ask_id", "rule_id")


def inserted(rules: DataFrame, new: DataFrame) -> DataFrame:
    """rules with those of new(ord, symbol, form, embedding, upper) that they lack, each once, numbered on in the order of ord.

    New rules are what a round of learning brings, so they are numbered in one task.
    """
    fresh = keyed(new).join(keyed(rules).select(*KEYS), KEYS, "left_anti").groupBy(*KEYS).agg(F.min(F.struct("ord", "symbol")).alias("first"))
    last = rules.agg(F.coalesce(F.max("rule_id"), F.lit(-1)).alias("last"))
    nth = F.row_number().over(W.orderBy("first.ord"))
    added = fresh.withColumn("nth", nth).join(F.broadcast(last), F.lit(True))  # one row
    return keyed(rules).select("rule_id", "symbol", *KEYS).unionByName(added.select((F.col("last") + F.col("nth")).alias("rule_id"), F.col("first.symbol").alias("symbol"), *KEYS))


def rematch(old: DataFrame, g: Graphs, changed: DataFrame, p: Pattern, whole: bool = True) -> DataFrame:
    """Matches of p in g from those of its former state: kept where nothing changed, found anew in the graphs that changed(graph_id) names."""
    ids = changed.select("graph_id").distinct()
    part = Graphs(g.nodes.join(ids, "graph_id", "left_semi"), g.edges.join(ids, "graph_id", "left_semi"))
    return old.join(ids, "graph_id", "left_anti").unionByName(match(part, p, whole))


def reclosed(closed: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The closure of edges from that of their former state: made anew for the graphs that changed(graph_id) names, as a removed node can part what it joined."""
    ids = changed.select("graph_id").distinct()
    return closed.join(ids, "graph_id", "left_anti").unionByName(closure(edges.join(ids, "graph_id", "left_semi")))


def parse_graph(steps: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A derivation as a graph of two levels, from steps(graph_id, seq, rule_id) and rules(rule_id, labels, edges ARRAY<STRUCT<a, b, x>>).

    nodes: graph_id, seq, pos, label; edges: graph_id, level, seq_a, pos_a, seq_b, pos_b, label. Level 1 has
    each step's right-hand side, level 2 joins the nonterminal of a step (the last
    of its nodes) to the first node of what replaced it.
    """
    at = steps.join(small(rules), "rule_id")
    nodes = at.select("graph_id", "seq", F.posexplode("labels").alias("pos", "label"))
    text, after = F.lit(None).cast("string"), F.lead("seq").over(W.partitionBy("graph_id").orderBy("seq"))
    edge = lambda level, a, i, b, j, x: F.struct(F.lit(level).alias("level"), a.alias("seq_a"), i.cast("int").alias("pos_a"), b.alias("seq_b"), j.cast("int").alias("pos_b"), x.cast("string").alias("label"))
    inner = F.transform("edges", lambda e: edge(1, F.col("seq"), e["a"], F.col("seq"), e["b"], e["x"]))
    outer = F.array(edge(2, F.col("seq"), F.size("labels") - 1, F.col("next"), F.lit(0), text))
    at = at.withColumn("next", after)
    both = F.concat(F.coalesce(inner, F.slice(outer, 1, 0)), F.when(F.col("next").isNotNull(), outer).otherwise(F.slice(outer, 1, 0)))
    # in one pass, so that all stays dealt by graph
    return nodes, at.select("graph_id", F.inline(both))


def split_into(g: Graphs, groups: DataFrame) -> Graphs:
    """The subgraphs on groups(graph_id, group, node_id) as graphs of their own, named by (graph_id, group)."""
    ids = F.struct("graph_id", "group")
    nodes = g.nodes.join(groups, ["graph_id", "node_id"]).select(ids.alias("graph_id"), "node_id", "label")
    ends = groups.select("graph_id", "group", "node_id")
    edges = g.edges.join(ends.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).join(ends.withColumnRenamed("node_id", "dst"), ["graph_id", "group", "dst"])
    return Graphs(nodes, edges.select(ids.alias("graph_id"), "src", "dst", "label"))


def plain_instructions(around: DataFrame, isms: DataFrame, g: Graphs) -> DataFrame:
    """graph_id, ism_id, x, mu, needed: pairs (label in the match, label of a neighbour) that undirected rules need, or forbid, for matches(graph_id, ism_id, nodes).

    around is what instructions.surroundings() gives.
    """
    held = isms.select("graph_id", "ism_id", F.posexplode("nodes").alias("pos", "node_id")).join(g.nodes.select("graph_id", "node_id", F.col("label").alias("x")), ["graph_id", "node_id"])
    near = around.select("graph_id", "ism_id", "y", "mu").distinct()
    joined = around.select("graph_id", "ism_id", "y", "pos", F.lit(True).alias("joined")).distinct()
    pairs = near.join(held.select("graph_id", "ism_id", "pos", "x"), ["graph_id", "ism_id"]).join(joined, ["graph_id", "ism_id", "y", "pos"], "left")
    return pairs.select("graph_id", "ism_id", "x", "mu", F.col("joined").isNotNull().alias("needed")).distinct()
