"""Closures, levels, hashes and canonical forms of graph collections."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut, kept
from weftgraph.operators.shapes import small
from weftgraph.sources.views import Graphs, apart


def per_graph(g: Graphs, fn: Callable[[dict, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows graph_id, *fn(labels by node, edges) for each graph; a graph is a row while it travels, so small ones cost little.

    For collections of graphs that fit a task each. Graphs that are equal in nodes, labels and edges are given to fn once,
    unless most are alone: then equal ones are not looked for.
    """
    run, typed = _rows(g.nodes, fn, schema)
    every = kept(_arrays(g))
    firsts = cut(every.groupBy("nodes", "edges").agg(F.min("graph_id").alias("graph_id")))
    if firsts.count() * 2 > every.count():
        return every.mapInPandas(run, typed)
    found = apart(firsts, "graph_id").mapInPandas(run, typed)
    found = found.groupBy("graph_id").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "graph_id"])).alias("rows"))
    packs = small(cut(firsts.withColumnRenamed("graph_id", "first").join(found.withColumnRenamed("graph_id", "first"), "first").drop("first")))
    return every.join(packs, ["nodes", "edges"]).select("graph_id", F.inline("rows"))


def per_kind(g: Graphs | DataFrame, fn: Callable[[dict, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows graph_id, *fn(labels by node, edges), often as of per_graph(), but for the least of the graphs that are equal only; often tells how many are.

    g: a collection, or graph_id, nodes, edges, often of graphs that differ, which are worked on as they are dealt.
    """
    firsts = g if isinstance(g, DataFrame) else apart(cut(_arrays(g).groupBy("nodes", "edges").agg(F.min("graph_id").alias("graph_id"), F.count("*").alias("often"))), "graph_id")
    run, typed = _rows(firsts, fn, schema, "often")
    return firsts.select("graph_id", "nodes", "edges", "often").mapInPandas(run, f"{typed}, often long")


def _arrays(g: Graphs) -> DataFrame:
    """graph_id, nodes, edges: a row for each graph."""
    nodes = g.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "label"))).alias("nodes"))
    edges = g.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "label"))).alias("edges"))
    none = F.array().cast(edges.schema["edges"].dataType)
    return nodes.join(edges, "graph_id", "left").withColumn("edges", F.coalesce("edges", none))


def _rows(graphs: DataFrame, fn: Callable[[dict, list], Iterator[tuple]], schema: str, *also: str) -> tuple[Callable, str]:
    """fn over rows of _arrays(g), whose columns also follow what it gives, and the schema of that without them; graphs has the same ids."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in ("graph_id x, " + schema).split(",")] + list(also)
        for pdf in it:
            out = []
            for gid, n, e, *more in zip(pdf.graph_id, pdf.nodes, pdf.edges, *(pdf[c] for c in also), strict=True):
                labels = {x["node_id"]: x["label"] or "#" for x in n}
                found = sorted((x["src"], x["dst"], x["label"]) for x in (e if e is not None else []))
                out += [(gid, *row, *more) for row in fn(dict(sorted(labels.items())), found)]
            yield pd.DataFrame(out, columns=names)

    key = next(f.dataType.simpleString() for f in graphs.schema if f.name == "graph_id")
    return run, f"graph_id {key}, {schema}"


def closure(edges: DataFrame, reflexive: DataFrame | None = None) -> DataFrame:
    """graph_id, src, dst: all pairs that a path joins; with reflexive(graph_id, node_id), each of its nodes with itself as well.

    Paths double in each round, so there are as many rounds as the longest path's logarithm.
    """
    known = cut(edges.select("graph_id", "src", "dst").distinct())
    size = known.count()
    while True:
        step = known.withColumnsRenamed({"dst": "mid"}).join(known.withColumnRenamed("src", "mid"), ["graph_id", "mid"]).select("graph_id", "src", "dst")
        known = cut(known.unionByName(step).distinct())
        if (now := known.count()) == size:
            break
        size = now
    if reflexive is not None:
        known = known.unionByName(reflexive.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))).distinct()
    return known


def acyclic(closed: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, is_dag of each of graphs(graph_id); closed is their closure."""
    loops = closed.where("src = dst").select("graph_id").distinct().withColumn("loop", F.lit(True))
    return graphs.select("graph_id").distinct().join(loops, "graph_id", "left").select("graph_id", F.col("loop").isNull().alias("is_dag"))


def levels(g: Graphs) -> DataFrame:
    """graph_id, node_id, level, depth, rank_back: longest and shortest way from a root, longest way to a leaf.

    Null for nodes on or behind a cycle (level), or before one (rank_back).
    """

    def longest(nodes: dict, edges: list) -> dict:
        wait, after = dict.fromkeys(nodes, 0), {}
        for a, b, _ in edges:
            wait[b] += 1
            after.setdefault(a, []).append(b)
        ready, out = [n for n, w in wait.items() if not w], {}
        out.update(dict.fromkeys(ready, 0))
        best = dict.fromkeys(nodes, 0)
        while ready:
            n = ready.pop()
            out[n] = best[n]
            for b in after.get(n, ()):
                best[b] = max(best[b], best[n] + 1)
                wait[b] -= 1
                if not wait[b]:
                    ready.append(b)
        return out

    def run(nodes: dict, edges: list) -> Iterator[tuple]:
        edges = [e for e in edges if e[0] in nodes and e[1] in nodes]
        down, up = longest(nodes, edges), longest(nodes, [(b, a, x) for a, b, x in edges])
        ends, after = {b for _, b, _ in edges}, {}
        for a, b, _ in edges:
            after.setdefault(a, []).append(b)
        depth = {n: 0 for n in nodes if n not in ends}
        front = list(depth)
        for n in front:  # grows while it is read
            for b in after.get(n, ()):
                if b not in depth:
                    depth[b] = depth[n] + 1
                    front.append(b)
        for n in nodes:
            yield n, down.get(n), depth.get(n), up.get(n)

    return per_graph(g, run, "node_id long, level long, depth long, rank_back long")


def refined(g: Graphs, rounds: int = 2) -> DataFrame:
    """graph_id, node_id, h: hashes of labelled neighbourhoods, refined so many times by those of both directions."""
    h = g.nodes.select("graph_id", "node_id", F.md5(F.coalesce("label", F.lit("#"))).alias("h"))
    for _ in range(rounds):
        out = g.edges.join(h.select("graph_id", F.col("node_id").alias("dst"), "h"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("o"))
        into = g.edges.join(h.select("graph_id", F.col("node_id").alias("src"), "h"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("i"))
        h = h.join(out, ["graph_id", "node_id"], "left").join(into, ["graph_id", "node_id"], "left")
        h = h.select("graph_id", "node_id", F.md5(F.concat_ws("|", "h", F.coalesce("o", F.lit("")), F.coalesce("i", F.lit("")))).alias("h"))
    return h


def graph_hash(g: Graphs, rounds: int = 2) -> DataFrame:
    """graph_id, h: equal for isomorphic graphs; graphs that refinement can't tell apart share it as well."""
    return refined(g, rounds).groupBy("graph_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), ",")).alias("h"))


def canonical(labels: dict, edges: list, marked: tuple = ()) -> str:
    """A string that two labelled directed graphs share if and only if they are isomorphic (marked nodes on marked nodes)."""
    return canonical_order(labels, edges, marked)[0]


def canonical_order(labels: dict, edges: list, marked: tuple = ()) -> tuple[str, list]:
    """canonical(), and the nodes in the order that it stands for: nodes at equal places of equal strings are the images of each other.

    Colours are refined by those of neighbours; where a colour class has several
    nodes, each is tried as its first and the least string wins.
    """
    out: dict = {n: [] for n in labels}
    into: dict = {n: [] for n in labels}
    for a, b, x in edges:
        out[a].append((b, x or ""))
        into[b].append((a, x or ""))

    def numbered(keys: dict) -> dict:
        rank = {k: i for i, k in enumerate(sorted(set(keys.values())))}
        return {n: rank[k] for n, k in keys.items()}

    def refine(colour: dict) -> dict:
        while True:
            new = numbered({n: (colour[n], tuple(sorted((colour[b], x) for b, x in out[n])), tuple(sorted((colour[a], x) for a, x in into[n]))) for n in colour})
            if len(set(new.values())) == len(set(colour.values())):
                return new
            colour = new

    def best(colour: dict) -> tuple[str, list]:
        colour = refine(colour)
        classes: dict = {}
        for n, c in colour.items():
            classes.setdefault(c, []).append(n)
        several = next((c for c in sorted(classes) if len(classes[c]) > 1), None)
        if several is None:
            nodes = sorted(colour, key=colour.get)
            return ";".join(f"{labels[n]}{'*' * (n in marked)}" for n in nodes) + "/" + ";".join(sorted(f"{colour[a]}>{colour[b]}:{x or ''}" for a, b, x in edges)), nodes
        return min((best(numbered({n: (c, n != one) for n, c in colour.items()})) for one in classes[several]), key=lambda x: x[0])

    return best(numbered({n: (str(labels[n]), n in marked) for n in labels}))


def canonical_forms(g: Graphs) -> DataFrame:
    """graph_id, form: the canonical string of each graph."""
    return per_graph(g, lambda n, e: iter([(canonical(n, e),)]), "form string")


def canonical_places(g: Graphs) -> DataFrame:
    """graph_id, form, node_id, place: the canonical string of each graph, and where in it each node stands."""

    def run(labels: dict, edges: list) -> Iterator[tuple]:
        form, order = canonical_order(labels, edges)
        yield from ((form, n, k) for k, n in enumerate(order))

    return per_graph(g, run, "form string, node_id long, place int")


def aligned(places: DataFrame) -> DataFrame:
    """graph_id, first, node_id, image: each node's image in the first graph of its form, by canonical_places()."""
    first = places.groupBy("form").agg(F.min("graph_id").alias("first"))
    mine = places.join(first, "form")
    image = mine.where(F.col("graph_id") == F.col("first")).select("form", "place", F.col("node_id").alias("image"))
    return mine.join(image, ["form", "place"]).select("graph_id", "first", "node_id", "image")


def unrolled_hash(labels: dict, edges: list) -> str:
    """SHA-256 of the trees below all roots. Not complete: shared and repeated subtrees look alike. Needs a DAG."""
    after: dict = {n: [] for n in labels}
    ends = set()
    for a, b, _ in edges:
        after[a].append(b)
        ends.add(b)
    known: dict = {}

    def of(n) -> str:
        if n not in known:
            known[n] = hashlib.sha256(f"{labels[n]}({','.join(sorted(of(b) for b in after[n]))})".encode()).hexdigest()
        return known[n]

    return hashlib.sha256(",".join(sorted(of(n) for n in labels if n not in ends)).encode()).hexdigest()


def is_path(order: list, edges: set) -> bool:
    """Whether each node of an order is joined to the next."""
    return all(e in edges for e in pairwise(order))
