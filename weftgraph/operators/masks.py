"""Which rules may come next in a derivation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.rewriting import Graph, Rule, apply, connected
from weftgraph.operators.shapes import small


def reachable(g: Graph, start: set, back: bool = False) -> set:
    """Nodes that a path from (or to) one of start leads to, with start."""
    after: dict = {}
    for a, b, _ in g.edges:
        after.setdefault(b if back else a, []).append(a if back else b)
    seen, front = set(start), list(start)
    while front:
        for n in after.get(front.pop(), ()):
            if n not in seen:
                seen.add(n)
                front.append(n)
    return seen


def acyclic(g: Graph) -> bool:
    wait = dict.fromkeys(g.labels, 0)
    for _, b, _ in g.edges:
        wait[b] += 1
    ready, done = [n for n, w in wait.items() if not w], 0
    while ready:
        n = ready.pop()
        done += 1
        for a, b, _ in g.edges:
            if a == n:
                wait[b] -= 1
                if not wait[b]:
                    ready.append(b)
    return done == len(g.labels)


def hamiltonian(g: Graph) -> bool:
    """Whether a DAG has a path through all its nodes: whether each node of its only possible order is joined to the next."""
    level: dict = {}
    after = {}
    wait = dict.fromkeys(g.labels, 0)
    for a, b, _ in g.edges:
        after.setdefault(a, []).append(b)
        wait[b] += 1
    ready = [n for n, w in wait.items() if not w]
    for n in ready:
        level.setdefault(n, 0)
    while ready:
        n = ready.pop()
        for b in after.get(n, ()):
            level[b] = max(level.get(b, 0), level[n] + 1)
            wait[b] -= 1
            if not wait[b]:
                ready.append(b)
    return sorted(level.values()) == list(range(len(g.labels)))


def on_the_way(g: Graph, source: str, sink: str) -> bool:
    """Whether a source reaches every node and every node reaches a sink."""
    first, last = ({n for n, x in g.labels.items() if x == label} for label in (source, sink))
    return reachable(g, first) == reachable(g, last, back=True) == set(g.labels)


def legal(g: Graph, rules: list[Rule], nonterminals: set[str], step: int, most: int) -> list[bool]:
    """For each rule whether it can be the next: it fits the nonterminal, keeps the graph connected and free of cycles, and the last step ends it."""
    left = [n for n, x in g.labels.items() if x in nonterminals]
    out = []
    for r in rules:
        ok = len(left) == 1 and r.symbol == g.labels[left[0]] and not (step == most - 1 and nonterminals & set(r.labels))
        if ok:
            new = apply(g, left[0], r)[0]
            ok = connected(new) and acyclic(new)
        out.append(ok)
    return out


def masks(states: DataFrame, rules: list[Rule], nonterminals: set[str], most: int = 20) -> DataFrame:
    """states(id, rules ARRAY<INT> so far): id, mask ARRAY<BOOLEAN> over all rules; empty if the rules so far don't fit. Equal sequences are looked at once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for seq in pdf.rules:
                g = Graph({0: "black"}, set())
                for k in seq:
                    left = [n for n, x in g.labels.items() if x in nonterminals]
                    if len(left) != 1 or rules[k].symbol != g.labels[left[0]]:
                        g = None
                        break
                    g = apply(g, left[0], rules[k])[0]
                out.append(legal(g, rules, nonterminals, len(seq), most) if g else [])
            yield pd.DataFrame({"rules": pdf.rules, "mask": out})

    known = cut(states.select(F.col("rules").cast("array<int>").alias("rules")).distinct().mapInPandas(run, "rules array<int>, mask array<boolean>"))
    return states.select(F.col("id").cast("long").alias("id"), F.col("rules").cast("array<int>").alias("rules")).join(small(known), "rules").select("id", "mask")


def decode(states: DataFrame, rules: list[Rule], nonterminals: set[str], weights: DataFrame, most: int = 20, seed: int | None = None) -> DataFrame:
    """id, rules, ended: states(id, rules ARRAY<INT> so far) continued a rule a round, by weights and only where masks() allows it.

    weights(last, rule, weight) say how well a rule follows the last one (null: none yet). Without a seed the
    greatest weight of the legal rules wins, ties to the lesser rule; with one a legal rule
    is drawn in proportion to its weight, by a hash of seed, id and step, so
    that reruns agree. Rules without a positive weight are never taken. ended is false where
    no rule was left before the last nonterminal went, or where the rules so far don't fit. A round looks
    one step ahead for all states at once, and the weights join as one map for each last rule, of which
    there are as many as rules at most, and one.
    """
    ids = list(range(len(rules)))
    closing = [k for k in ids if not nonterminals & set(rules[k].labels)]
    known = weights.where((F.col("last").isNull() | F.col("last").isin(ids)) & F.col("rule").isin(ids) & (F.col("weight") > 0))
    known = known.select(F.coalesce(F.col("last").cast("int"), F.lit(-1)).alias("last"), F.col("rule").cast("int").alias("rule"), F.col("weight").cast("double").alias("weight")).groupBy("last", "rule").agg(F.sum("weight").alias("weight"))
    table = cut(known.groupBy("last").agg(F.map_from_entries(F.collect_list(F.struct("rule", "weight"))).alias("by")))
    last = F.coalesce(F.try_element_at("rules", F.lit(-1)), F.lit(-1))
    closed = last.isin(closing) if closing else F.lit(False)
    front = cut(states.select(F.col("id").cast("long").alias("id"), F.col("rules").cast("array<int>").alias("rules")))
    done = front.where(closed).select("id", "rules", F.lit(True).alias("ended"))
    front = front.where(~closed)
    for step in range(most):
        if front.isEmpty():
            break
        seen = front.join(masks(front, rules, nonterminals, most), "id").withColumn("last", last).join(F.broadcast(table), "last", "left")
        fits = F.filter(F.transform("mask", lambda x, k: F.struct(x.alias("ok"), F.try_element_at("by", k).alias("w"), k.alias("k"))), lambda x: x["ok"] & x["w"].isNotNull())
        if seed is None:
            key = lambda x: -x["w"]
        else:
            key = lambda x: -F.log((F.pmod(F.xxhash64(F.lit(seed), "id", F.size("rules"), x["k"]), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)) / x["w"]
        best = F.array_min(F.transform(fits, lambda x: F.struct(key(x).alias("key"), x["k"].alias("k"))))
        moved = cut(seen.select("id", "rules", best["k"].cast("int").alias("next")).select("id", F.when(F.col("next").isNull(), F.col("rules")).otherwise(F.array_append("rules", F.col("next"))).alias("rules"), F.col("next").isNull().alias("stuck")))
        done = done.unionByName(moved.where(F.col("stuck") | closed).select("id", "rules", (~F.col("stuck")).alias("ended")))
        front = moved.where(~F.col("stuck") & ~closed).select("id", "rules")
    return done.unionByName(front.select("id", "rules", F.lit(False).alias("ended")))


def made_edges(g: Graph, node: int, rule: Rule) -> set[tuple[str, str]]:
    """Label pairs (from, to) of the edges that a rule would make between its nodes and the replaced node's neighbours."""
    new, at, _ = apply(g, node, rule)
    return {(new.labels[a], new.labels[b]) for a, b, _ in new.edges if (a in at) != (b in at)}


def fits_amplifier(g: Graph, node: int, rule: Rule, source: str = "input", sink: str = "output") -> bool:
    """No edge may lead into a source or out of a sink, and there is one of each at most."""
    pairs = made_edges(g, node, rule) | {(rule.labels[a], rule.labels[b]) for a, b, _ in rule.edges}
    count = lambda x: sum(n == x for n in g.labels.values()) + sum(n == x for n in rule.labels)
    return all(b != source and a != sink for a, b in pairs) and count(source) <= 1 and count(sink) <= 1


def fits_network(g: Graph, node: int, rule: Rule) -> bool:
    """Each variable comes once."""
    left = [x for n, x in g.labels.items() if n != node] + list(rule.labels)
    return len(left) == len(set(left))


def fits_chain(g: Graph, node: int, rule: Rule) -> bool:
    """The graph stays one that a path goes through."""
    return hamiltonian(apply(g, node, rule)[0])


def post_order(children: dict[int, list[int]], root: int) -> list[int]:
    """A tree's nodes, children before parents."""
    out, front = [], [root]
    while front:
        n = front.pop()
        out.append(n)
        front += children.get(n, ())
    return out[::-1]


def breadth_first(g: Graph, start: int) -> list[int]:
    """Nodes in the order of their distance along edges of either direction, ties by id."""
    near: dict = {n: set() for n in g.labels}
    for a, b, _ in g.edges:
        near[a].add(b)
        near[b].add(a)
    order, seen = [start], {start}
    for n in order:
        new = sorted(near[n] - seen)
        seen |= set(new)
        order += new
    return order
