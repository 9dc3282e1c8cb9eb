"""Subgraph matching as joins: a pattern is compiled to a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.sources.views import Graphs


@dataclass(frozen=True)
class Pattern:
    """A small graph. labels: for each position a label, or None for any; edges: (from, to, label or None)."""

    labels: tuple[str | None, ...]
    edges: tuple[tuple[int, int, str | None], ...] = ()
    directed: bool = True

    @property
    def columns(self) -> list[str]:
        return [f"n{k}" for k in range(len(self.labels))]

    def between(self, a: int, b: int) -> dict[bool, str | None]:
        """The edges from a to b (True) and back (False), with their labels."""
        return {(x, y) == (a, b): label for x, y, label in self.edges if {x, y} == {a, b}}


def links(g: Graphs) -> DataFrame:
    """graph_id, a, b, fwd, back, fwd_label, back_label: every joined pair, seen from both ends."""
    no = F.lit(None).cast("string")
    one = g.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("f"), F.lit(False).alias("r"), F.col("label").alias("fl"), no.alias("rl"))
    two = g.edges.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("f"), F.lit(True).alias("r"), no.alias("fl"), F.col("label").alias("rl"))
    return one.unionByName(two).groupBy("graph_id", "a", "b").agg(F.max("f").alias("fwd"), F.max("r").alias("back"), F.max("fl").alias("fwd_label"), F.max("rl").alias("back_label"))


def _fitting(pairs: DataFrame, p: Pattern, a: int, b: int, induced: bool) -> DataFrame:
    """Pairs that can stand at positions a and b, which the pattern joins."""
    want, ok = p.between(a, b), F.lit(True)
    if not p.directed:
        return pairs.select("graph_id", F.col("a").alias(f"n{a}"), F.col("b").alias(f"n{b}"))
    for forward, held, label in ((True, "fwd", "fwd_label"), (False, "back", "back_label")):
        if forward in want:
            ok &= F.col(held) if want[forward] is None else F.col(held) & F.coalesce(F.col(label) == want[forward], F.lit(False))
        elif induced:
            ok &= ~F.col(held)
    return pairs.where(ok).select("graph_id", F.col("a").alias(f"n{a}"), F.col("b").alias(f"n{b}"))


def packed(g: Graphs) -> DataFrame:
    """graph_id, labels (by node), es (edges): a row for each graph, in the partitioning that the collection has already."""
    nodes = g.nodes.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.coalesce("label", F.lit("#"))))).alias("labels"))
    edges = g.edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "label")).alias("es"))
    none = F.array().cast(edges.schema["es"].dataType)
    return nodes.join(edges, "graph_id", "left").withColumn("es", F.coalesce("es", none))


def match(g: Graphs, p: Pattern, induced: bool = True, small: bool = True) -> DataFrame:
    """graph_id, n0, n1, ..., n0_label, ...: each way to lay p on g, one row for each mapping.

    Induced: nodes that p doesn't join aren't joined in g either, in neither
    direction. A missing label is "#".

    small: graphs fit a row each. They are gathered once, by graph, and positions are
    filled one after the other from the graph's own edges, so there is no join and no
    shuffle beyond the first. Otherwise, for large graphs: each position that p
    joins to an earlier one is an equi-join on (graph, node) with the pairs of g, and
    each pair of positions that p doesn't join is an anti-join.
    """
    if small:
        return _match_rows(packed(g), p, induced)
    return label_of(_match_joins(g, p, induced), g, p.columns).select("graph_id", *p.columns, *[f"{c}_label" for c in p.columns])


def _match_rows(graphs: DataFrame, p: Pattern, induced: bool) -> DataFrame:
    def edge(a, b, label: str | None):
        return F.exists("es", lambda e: (e["src"] == a) & (e["dst"] == b) & (F.lit(True) if label is None else F.coalesce(e["label"] == label, F.lit(False))))

    def fits(k: int, done: list[int]):
        """Whether position k agrees with the earlier ones."""
        n, ok = F.col(f"n{k}"), F.lit(True)
        if p.labels[k] is not None:
            ok &= F.element_at("labels", n) == p.labels[k]
        for d in done:
            m, want = F.col(f"n{d}"), p.between(d, k)
            ok &= n != m
            if not p.directed:
                joined = edge(m, n, None) | edge(n, m, None)
                ok &= joined if want else (~joined if induced else F.lit(True))
                continue
            for forward, a, b in ((True, m, n), (False, n, m)):
                if forward in want:
                    ok &= edge(a, b, want[forward])
                elif induced:
                    ok &= ~edge(a, b, None)
        return ok

    nodes = F.map_keys("labels")
    plan = graphs.withColumn("n0", F.explode(nodes)).where(fits(0, []))
    done = [0]
    while len(done) < len(p.labels):
        rest = [k for k in range(len(p.labels)) if k not in done]
        k, via = next(((k, d) for k in rest for d in done if p.between(d, k)), (rest[0], None))
        if via is None:
            near = nodes
        else:
            at = F.col(f"n{via}")
            ahead = F.transform(F.filter("es", lambda e: e["src"] == at), lambda e: e["dst"])  # noqa: B023
            behind = F.transform(F.filter("es", lambda e: e["dst"] == at), lambda e: e["src"])  # noqa: B023
            want = p.between(via, k)
            near = F.array_union(ahead, behind) if not p.directed else F.array_distinct(ahead if True in want else behind)
        plan = plan.withColumn(f"n{k}", F.explode(near)).where(fits(k, done))
        done.append(k)
    return plan.select("graph_id", *p.columns, *[F.element_at("labels", F.col(c)).alias(f"{c}_label") for c in p.columns])


def _match_joins(g: Graphs, p: Pattern, induced: bool) -> DataFrame:
    """Labels filter first."""
    pairs = links(g)
    own = g.nodes.select("graph_id", "node_id", F.coalesce("label", F.lit("#")).alias("l"))

    def at(k: int) -> DataFrame:
        some = own if p.labels[k] is None else own.where(F.col("l") == p.labels[k])
        return some.select("graph_id", F.col("node_id").alias(f"n{k}"))

    done, plan = [0], at(0)
    while len(done) < len(p.labels):
        rest = [k for k in range(len(p.labels)) if k not in done]
        k, via = next(((k, d) for k in rest for d in done if p.between(d, k)), (rest[0], None))
        if via is None:
            plan = plan.join(at(k), "graph_id")
        else:
            plan = plan.join(_fitting(pairs, p, via, k, induced), ["graph_id", f"n{via}"])
            if p.labels[k] is not None:
                plan = plan.join(at(k), ["graph_id", f"n{k}"], "left_semi")
        for e in done:
            if e != via and p.between(e, k):
                plan = plan.join(_fitting(pairs, p, e, k, induced), ["graph_id", f"n{e}", f"n{k}"], "left_semi")
            elif e != via:
                plan = plan.where(F.col(f"n{k}") != F.col(f"n{e}"))
                if induced:
                    plan = plan.join(pairs.select("graph_id", F.col("a").alias(f"n{e}"), F.col("b").alias(f"n{k}")), ["graph_id", f"n{e}", f"n{k}"], "left_anti")
        done.append(k)
    return plan.select("graph_id", *p.columns)


def label_of(isms: DataFrame, g: Graphs, columns: list[str]) -> DataFrame:
    """isms with the label of each of the node columns, as <column>_label."""
    for c in columns:
        isms = isms.join(g.nodes.select("graph_id", F.col("node_id").alias(c), F.coalesce("label", F.lit("#")).alias(f"{c}_label")), ["graph_id", c])
    return isms


def support(g: Graphs, p: Pattern, induced: bool = True) -> DataFrame:
    """For each sequence of labels that p is found with: n_matches and n_graphs."""
    return match(g, p, induced).groupBy(*[f"{c}_label" for c in p.columns]).agg(F.count("*").alias("n_matches"), F.countDistinct("graph_id").alias("n_graphs"))


def node_sets(isms: DataFrame, columns: list[str]) -> DataFrame:
    """graph_id, nodes, n_mappings: matches that cover the same nodes as one row."""
    return isms.groupBy("graph_id", F.array_sort(F.array(*columns)).alias("nodes")).agg(F.count("*").alias("n_mappings"))


def containing(g: Graphs, p: Pattern, induced: bool = True) -> DataFrame:
    """graph_id of the graphs that p is found in."""
    return match(g, p, induced).select("graph_id").distinct()


def linear(isms: DataFrame, g: Graphs, nonterminals: list[str]) -> DataFrame:
    """Without matches in graphs that hold a nonterminal: what a pattern of terminals only may be laid on."""
    return isms.join(g.nodes.where(F.col("label").isin(nonterminals)).select("graph_id"), "graph_id", "left_anti")


def touching(isms: DataFrame, g: Graphs) -> DataFrame:
    """graph_id, a, b: pairs of matches(graph_id, ism_id, nodes) of one graph that share nodes or are joined by an edge."""
    at = isms.select("graph_id", "ism_id", F.explode("nodes").alias("node_id"))
    near = at.unionByName(at.join(g.edges.select("graph_id", F.col("src").alias("node_id"), "dst"), ["graph_id", "node_id"]).select("graph_id", "ism_id", F.col("dst").alias("node_id")))
    pairs = near.withColumnRenamed("ism_id", "x").join(at.withColumnRenamed("ism_id", "y"), ["graph_id", "node_id"]).where("x <> y")
    return pairs.select("graph_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def first_of_each(keyed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: isomorphic copies dropped, the earliest kept."""
    return keyed.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_nth = 1").drop("_nth")
