"""How many derivations graphs have, by a frontier of states that all graphs share."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.derivations import unapplied
from weftgraph.operators.rewriting import Graph, Rule, connected

#: Further states that a task follows for each batch of those that it was given.
AHEAD = 5_000


def _packed(states: dict[str, Graph]) -> tuple[str, str]:
    """The key of a set of graphs by form, and the graphs as JSON."""
    forms = sorted(states)
    graphs = [[sorted(states[f].labels.items()), sorted(states[f].edges)] for f in forms]
    return hashlib.md5("\n".join(forms).encode()).hexdigest(), json.dumps(graphs)


def _unpacked(text: str) -> list[Graph]:
    return [Graph({n: x for n, x in nodes}, {tuple(e) for e in edges}) for nodes, edges in json.loads(text)]


def derivation_counts(graphs: DataFrame, rules: list[Rule], nonterminals: set[str], start: str = "black", most: int = 10_000) -> DataFrame:
    """graphs(graph_id, nodes ARRAY<STRUCT<node_id, label>>, edges ARRAY<STRUCT<src, dst, label>>): graph_id, n_derivations.

    Derivations are rule sequences with one nonterminal at a time, as of
    derivations.derivations. A state is the set of all graphs that some sequence of last rules can lead back to, kept by
    the forms of its graphs, so that each sequence is one path of states however many
    graphs it passes. States are rows: whatever graphs and rounds one comes from, it is
    taken apart once. Counts then spread from the start graph's states; sequences are never listed and the
    number of states has no bound. Rules that lead back for ever raise after so many rounds.
    """
    shared = graphs.sparkSession.sparkContext.broadcast((rules, nonterminals, start))

    def begin(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, n, e in zip(pdf.graph_id, pdf.nodes, pdf.edges, strict=True):
                g = Graph({int(x["node_id"]): x["label"] for x in n}, {(int(x["src"]), int(x["dst"]), x["label"]) for x in (e if e is not None else ())})
                out.append((i, *_packed({g.form(): g})))
            yield pd.DataFrame(out, columns=["graph_id", "key", "state"])

    def back(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, nonterminals, start = shared.value
        held = [sum(x in nonterminals for x in r.labels) for r in rules]
        for pdf in it:
            rows, wait = [], deque(zip(pdf.key, pdf.state, strict=True))
            done, enough = {k for k, _ in wait}, len(wait) + AHEAD
            while wait:
                key, text = wait.popleft()
                now = _unpacked(text)
                ends = any(list(g.labels.values()) == [start] and not g.edges for g in now)
                rows.append((key, None, None, None, int(ends)))
                for k, rule in enumerate(rules):
                    before = {}
                    for g in now:
                        if sum(x in nonterminals for x in g.labels.values()) == held[k]:
                            before |= {b.form(): b for b in unapplied(g, rule) if connected(b)}
                    if before:
                        child, state = _packed(before)
                        rows.append((key, k, child, state, None))
                        if child not in done and len(done) < enough:
                            done.add(child)
                            wait.append((child, state))
            yield pd.DataFrame(rows, columns=["key", "rule", "child", "state", "ends"]).astype({"rule": "Int64", "ends": "Int64"})

    roots = cut(graphs.select("graph_id", "nodes", "edges").mapInPandas(begin, f"graph_id {dict(graphs.dtypes)['graph_id']}, key string, state string"))
    front, seen, arcs = roots.groupBy("key").agg(F.min("state").alias("state")), None, None
    for _ in range(most):
        new = cut(front.mapInPandas(back, "key string, rule long, child string, state string, ends long"))
        arcs = new if arcs is None else arcs.unionByName(new)
        keys = new.select("key").distinct()
        seen = cut(keys if seen is None else seen.unionByName(keys).distinct())
        asked = new.where("child IS NOT NULL").groupBy(F.col("child").alias("key")).agg(F.min("state").alias("state"))
        front = cut(asked.join(seen, "key", "left_anti"))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"states are left after {most} rounds")
    ends = cut(arcs.where("ends IS NOT NULL").groupBy("key").agg(F.max("ends").alias("ends")))
    steps = cut(arcs.where("child IS NOT NULL").select("key", "rule", "child").distinct())
    # the sequences of n rules that lead back from each state to the start, for n = 0, 1, ...
    layer = ends.where("ends > 0").select("key", F.col("ends").alias("n"))
    total = None
    for _ in range(most):
        layer = cut(layer)
        if layer.isEmpty():
            break
        total = layer if total is None else total.unionByName(layer)
        layer = steps.join(layer.withColumnRenamed("key", "child"), "child").groupBy("key").agg(F.sum("n").alias("n"))
    else:
        raise RuntimeError("rules lead back for ever")
    if total is None:
        return roots.select("graph_id", F.lit(0).cast("long").alias("n_derivations"))
    return roots.join(total.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").select("graph_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_derivations"))
