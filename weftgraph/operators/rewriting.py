"""Edge-directed graph grammars with neighbourhood-controlled embedding: contraction and derivation.

An instruction is (mu, p, q, pos, d, d2): for a neighbour labelled mu that an edge
labelled p joins to the replaced node in direction d, an edge labelled q in
direction d2 joins position pos. Directions are seen from the replaced node:
"out" leads to the neighbour. If a neighbour is joined both ways, only "out"
counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.shapes import small
from weftgraph.operators.traversal import canonical
from weftgraph.sources.views import Graphs

Instruction = tuple[str, str, str, int, str, str]


@dataclass(frozen=True)
class Rule:
    """A nonterminal's label, and what stands in its place."""

    symbol: str
    labels: tuple[str, ...]
    edges: tuple[tuple[int, int, str], ...]
    embedding: frozenset[Instruction] = frozenset()


@dataclass
class Graph:
    """One labelled directed graph in a task."""

    labels: dict[int, str]
    edges: set[tuple[int, int, str]]

    def form(self) -> str:
        return canonical(self.labels, sorted(self.edges))


def apply(g: Graph, node: int, rule: Rule) -> tuple[Graph, list[int], set[Instruction]]:
    """g with the rule in place of node, the new nodes, and the instructions that took effect."""
    first = max(g.labels) + 1
    new = list(range(first, first + len(rule.labels)))
    labels = {n: x for n, x in g.labels.items() if n != node} | dict(zip(new, rule.labels, strict=True))
    edges = {e for e in g.edges if node not in e[:2]} | {(new[a], new[b], x) for a, b, x in rule.edges}
    out = {b: x for a, b, x in g.edges if a == node}
    into = {a: x for a, b, x in g.edges if b == node and a not in out}
    used = set()
    for d, joined in (("out", out), ("in", into)):
        for y, label in joined.items():
            for i in rule.embedding:
                if i[0] == g.labels[y] and i[1] == label and i[4] == d:
                    used.add(i)
                    edges.add((new[i[3]], y, i[2]) if i[5] == "out" else (y, new[i[3]], i[2]))
    return Graph(labels, edges), new, used


def derive(rules: list[Rule], sequence: list[int], nonterminals: set[str], start: str = "black") -> Graph:
    """A start node rewritten by a sequence of rules, until none is left or no nonterminal is; one nonterminal at a time."""
    g = Graph({0: start}, set())
    for k in sequence:
        left = [n for n, x in g.labels.items() if x in nonterminals]
        if not left:
            break
        if len(left) > 1 or g.labels[left[0]] != rules[k].symbol:
            raise ValueError(f"rule {k} doesn't fit {[g.labels[n] for n in left]}")
        g = apply(g, left[0], rules[k])[0]
    return g


def connected(g: Graph) -> bool:
    near: dict = {n: set() for n in g.labels}
    for a, b, _ in g.edges:
        near[a].add(b)
        near[b].add(a)
    if not near:
        return True
    front = [next(iter(near))]
    seen = set(front)
    while front:
        new = near[front.pop()] - seen
        seen |= new
        front += new
    return len(seen) == len(near)


def sample(rules: list[Rule], nonterminals: set[str], seed: int, start: str = "black", steps: int = 100) -> tuple[list[int], Graph] | None:
    """A random derivation that keeps the graph connected, or None after so many steps."""
    rng = random.Random(seed)
    g, used = Graph({0: start}, set()), []
    for _ in range(steps):
        left = sorted(n for n, x in g.labels.items() if x in nonterminals)
        if not left:
            return used, g
        node = rng.choice(left)
        fit = [k for k, r in enumerate(rules) if r.symbol == g.labels[node]]
        if not fit:
            return None
        k = rng.choice(fit)
        new = apply(g, node, rules[k])[0]
        if connected(new):
            g = new
            used.append(k)
    return None


def derive_all(sequences: DataFrame, rules: list[Rule], nonterminals: set[str]) -> DataFrame:
    """sequences(seq_id, rules ARRAY<INT>): seq_id, form, n_nodes, n_edges, problem. Each different sequence is derived once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for seq in pdf.rules:
                try:
                    g = derive(rules, [int(k) for k in seq], nonterminals)
                    out.append((g.form(), len(g.labels), len(g.edges), None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=["form", "n_nodes", "n_edges", "problem"]).astype({"n_nodes": "Int64", "n_edges": "Int64"})
            frame.insert(0, "rules", pdf["rules"].array)
            yield frame

    own = sequences.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("rules").cast("array<int>").alias("rules"))
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = own.where("rules IS NOT NULL").select("rules").distinct().repartition(n)  # few bytes, but much work
    made = small(cut(each.mapInPandas(run, "rules array<int>, form string, n_nodes long, n_edges long, problem string")))
    problem = F.when(F.col("rules").isNull(), "no rules").otherwise(F.col("problem"))
    return own.join(made, "rules", "left").select("seq_id", "form", "n_nodes", "n_edges", problem.alias("problem"))


def generate(spark, rules: list[Rule], nonterminals: set[str], tries: int, seed: int = 1) -> DataFrame:
    """form, n_nodes, first_try, n_found: distinct graphs among so many random derivations, each with a seed of its own."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [(int(k), sample(rules, nonterminals, seed * 1_000_003 + int(k))) for k in pdf.id]
            yield pd.DataFrame([(k, f[1].form(), len(f[1].labels)) for k, f in found if f], columns=["id", "form", "n_nodes"])

    made = spark.range(tries).mapInPandas(run, "id long, form string, n_nodes long")
    return made.groupBy("form").agg(F.max("n_nodes").alias("n_nodes"), F.min("id").alias("first_try"), F.count("*").alias("n_found"))


def contract(g: Graphs, isms: DataFrame, label: str) -> Graphs:
    """g with each of isms(graph_id, ism_id, nodes) as one node of the label; matches of a graph must not overlap.

    The new node takes the least id of the match. Edges inside go; others keep their
    labels and end at the new node, without repeats.
    """
    inside = isms.select("graph_id", F.explode("nodes").alias("node_id"), F.array_min("nodes").alias("new"))
    ends = inside.select("graph_id", F.col("node_id").alias("src"), F.col("new").alias("a"))
    heads = inside.select("graph_id", F.col("node_id").alias("dst"), F.col("new").alias("b"))
    e = g.edges.join(ends, ["graph_id", "src"], "left").join(heads, ["graph_id", "dst"], "left")
    e = e.select("graph_id", F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "label").where("src <> dst").distinct()
    n = g.nodes.join(inside.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", "label")
    return Graphs(n.unionByName(inside.select("graph_id", F.col("new").alias("node_id"), F.lit(label).alias("label")).distinct()), e)


def apply_once(g: Graphs, at: DataFrame, rule: Rule) -> Graphs:
    """The rule applied to one node of each graph that at(graph_id, node_id) names, as joins."""
    spark = g.nodes.sparkSession
    last = g.nodes.groupBy("graph_id").agg(F.max("node_id").alias("last"))
    place = at.join(last, "graph_id")
    rhs = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(x).alias("label")) for k, x in enumerate(rule.labels)]))
    new = place.select("graph_id", "last", rhs.alias("r")).select("graph_id", (F.col("last") + 1 + F.col("r.pos")).alias("node_id"), F.col("r.label").alias("label"))
    nodes = g.nodes.join(at, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", "label").unionByName(new)
    gone = at.select("graph_id", F.col("node_id").alias("gone"))
    e = g.edges.join(gone, "graph_id", "left")
    kept = e.where("gone IS NULL OR (src <> gone AND dst <> gone)").select("graph_id", "src", "dst", "label")
    out = e.where("src = gone").select("graph_id", "gone", F.col("dst").alias("y"), F.col("label").alias("p"), F.lit("out").alias("d"))
    into = e.where("dst = gone").select("graph_id", "gone", F.col("src").alias("y"), F.col("label").alias("p"), F.lit("in").alias("d"))
    near = out.unionByName(into.join(out, ["graph_id", "y"], "left_anti"))
    near = near.join(g.nodes.select("graph_id", F.col("node_id").alias("y"), F.col("label").alias("mu")), ["graph_id", "y"])
    made = kept
    if rule.edges:
        inner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("x")) for a, b, x in rule.edges]))
        made = made.unionByName(place.select("graph_id", "last", inner.alias("r")).select("graph_id", (F.col("last") + 1 + F.col("r.a")).alias("src"), (F.col("last") + 1 + F.col("r.b")).alias("dst"), F.col("r.x").alias("label")))
    if rule.embedding:
        table = F.broadcast(spark.createDataFrame(sorted(rule.embedding), "mu string, p string, q string, pos int, d string, d2 string"))  # a rule's own, so small
        hit = near.join(table, ["mu", "p", "d"]).join(place.select("graph_id", "last"), "graph_id")
        x = F.col("last") + 1 + F.col("pos")
        made = made.unionByName(hit.select("graph_id", F.when(F.col("d2") == "out", x).otherwise(F.col("y")).alias("src"), F.when(F.col("d2") == "out", F.col("y")).otherwise(x).alias("dst"), F.col("q").alias("label")))
    return Graphs(nodes, made.distinct())


def one_per_graph(realisations: DataFrame) -> DataFrame:
    """The first realisation(graph_id, ism_id, dir_id) of each graph: with one nonterminal a graph at most, those of different graphs never conflict."""
    nth = F.row_number().over(W.partitionBy("graph_id").orderBy("ism_id", "dir_id"))
    return realisations.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
