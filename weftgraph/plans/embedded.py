"""Learning rules with embedding instructions, so that what is learnt derives every input again.

Motifs are two joined nodes; larger right-hand sides come from rules inside rules. A
contraction chooses, for each kind of neighbour, the direction of the edge to the
new node; what a match needs of the embedding and what it forbids follows. A rule
serves a set of realisations of which none needs what another forbids: a clique of
the compatibility graph, grown over kinds of realisations by how many graphs have
them, with the union of needs as its lower bound and all that isn't forbidden as its
upper one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.matching import packed
from weftgraph.operators.rewriting import Graph, Rule, apply
from weftgraph.sources.views import Graphs

Motif = tuple[tuple[str, str], tuple]
STATE = "graph_id {key}, form string, state string"


@dataclass(frozen=True)
class Learnt:
    """A rule, the instructions that any use may have, and how many graphs made it."""

    rule: Rule
    upper: frozenset
    n_graphs: int


def matches(g: Graph, nonterminal: str) -> list[tuple[Motif, tuple[int, int]]]:
    """Joined pairs, in order; in a graph that holds a nonterminal those with it, so that it stays the only one."""
    held, out = nonterminal in g.labels.values(), []
    between: dict = {}
    for a, b, x in g.edges:
        if a != b:
            between.setdefault((min(a, b), max(a, b)), []).append((a, b, x))
    for pair, edges in between.items():
        if sum(g.labels[n] == nonterminal for n in pair) == held:
            forms = []
            for order in (pair, pair[::-1]):
                place = {n: k for k, n in enumerate(order)}
                forms.append((((g.labels[order[0]], g.labels[order[1]]), tuple(sorted((place[a], place[b], x) for a, b, x in edges))), order))
            out.append(min(forms))
    return sorted(out)


def realised(g: Graph, nodes: tuple[int, ...], kinds: list[str], black: str) -> Iterator[tuple[dict[int, str], frozenset, frozenset]]:
    """Each way to contract nodes: direction of the new edge to each neighbour, instructions needed, and forbidden.

    Neighbours of one label with different edges to the match need different
    directions, so there are two ways for a label with one or two kinds, and none
    with more: choices are made label by label and never enumerated beyond that.
    """
    place, around = {n: k for k, n in enumerate(nodes)}, {}
    for a, b, x in g.edges:
        if (a in place) != (b in place):
            y, edge = (b, (place[a], "out", x)) if a in place else (a, (place[b], "in", x))
            around.setdefault(y, set()).add(edge)
    by_label: dict = {}
    for y, edges in sorted(around.items()):
        by_label.setdefault(g.labels[y], {}).setdefault(frozenset(edges), []).append(y)
    every = [(pos, d, q) for pos in range(len(nodes)) for d in ("in", "out") for q in kinds]
    options = []
    for mu, signatures in sorted(by_label.items()):
        held = sorted(signatures.items(), key=lambda s: sorted(s[0]))
        if len(held) > 2:
            return
        ways = [("in",), ("out",)] if len(held) == 1 else [("in", "out"), ("out", "in")]
        options.append([[(mu, s, ys, d) for (s, ys), d in zip(held, way, strict=True)] for way in ways])
    for chosen in product(*options):
        new, ins, outs = {}, set(), set()
        for mu, signature, ys, d in (x for part in chosen for x in part):
            new |= dict.fromkeys(ys, d)
            for pos, d2, q in every:
                (ins if (pos, d2, q) in signature else outs).add((mu, black, q, pos, d, d2))
        yield new, frozenset(ins), frozenset(outs)


def contracted(g: Graph, nodes: tuple[int, ...], new: dict[int, str], nonterminal: str, black: str) -> Graph:
    """g with nodes as one, named like the least of them, and an edge to each neighbour in the chosen direction."""
    one, inside = min(nodes), set(nodes)
    rest = {e for e in g.edges if e[0] not in inside and e[1] not in inside}
    joined = {(one, y, black) if d == "out" else (y, one, black) for y, d in new.items()}
    return Graph({n: x for n, x in g.labels.items() if n not in inside} | {one: nonterminal}, rest | joined)


def admits(rule: Rule, ins: frozenset, outs: frozenset) -> bool:
    return ins <= rule.embedding and not outs & rule.embedding


def compressed(g: Graph, rules: list[Rule], nonterminal: str, kinds: list[str], black: str) -> tuple[Graph, list[int]]:
    """g with rules applied backwards until none fits, the earliest rule first, and the rules in that order."""
    steps: list[int] = []
    by_motif: dict = {}
    for k, r in enumerate(rules):
        by_motif.setdefault((r.labels, r.edges), []).append(k)
    while True:
        best = None
        for motif, nodes in matches(g, nonterminal):
            ks = [k for k in by_motif.get(motif, ()) if best is None or k < best[0]]
            for new, ins, outs in realised(g, nodes, kinds, black) if ks else ():
                k = next((k for k in ks if admits(rules[k], ins, outs)), None)
                if k is not None and (best is None or k < best[0]):
                    best = (k, nodes, new)
        if best is None:
            return g, steps
        steps.append(best[0])
        g = contracted(g, best[1], best[2], nonterminal, black)


def _load(state: str) -> tuple[Graph, list[int]]:
    s = json.loads(state)
    return Graph({int(n): x for n, x in s["labels"]}, {(a, b, x) for a, b, x in s["edges"]}), s["steps"]


def _dump(g: Graph, steps: list[int]) -> str:
    return json.dumps({"labels": sorted(g.labels.items()), "edges": sorted(g.edges), "steps": steps})


def _start(graphs: Graphs) -> DataFrame:
    """A row for each graph: its canonical form and its state."""
    rows = packed(graphs).select("graph_id", F.map_keys("labels").alias("ids"), F.map_values("labels").alias("names"), F.col("es.src").alias("src"), F.col("es.dst").alias("dst"), F.col("es.label").alias("kinds"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [Graph(dict(zip(map(int, n), x, strict=True)), set(zip(map(int, a), map(int, b), k, strict=True))) for n, x, a, b, k in zip(pdf.ids, pdf.names, pdf.src, pdf.dst, pdf.kinds, strict=True)]
            yield pd.DataFrame({"graph_id": pdf.graph_id, "form": [g.form() for g in made], "state": [_dump(g, []) for g in made]})

    return rows.mapInPandas(run, STATE.format(key=rows.schema["graph_id"].dataType.simpleString()))


def clique(signatures: list[tuple[int, frozenset, frozenset]]) -> tuple[frozenset, frozenset]:
    """Needs and bans of a largest-first clique of compatible kinds (n_graphs, ins, outs)."""
    needs, bans = set(), set()
    for _, ins, outs in sorted(signatures, key=lambda s: (-s[0], sorted(s[1]), sorted(s[2]))):
        if not (ins & bans or outs & needs):
            needs |= ins
            bans |= outs
    return frozenset(needs), frozenset(bans)


def learn(graphs: Graphs, nonterminal: str = "gray", black: str = "black") -> tuple[list[Learnt], DataFrame]:
    """Rules in the order of their making, and graph_id, form (of the input), state (what is left, and the rules used).

    Each round takes the motif that most graphs hold, makes a rule of its best
    clique of realisations, and applies all rules to every graph until none fits. It
    ends when no graph holds a pair that can be contracted; each round contracts one
    at least. What comes to the driver are kinds: of motifs the best one, and its kinds
    of realisations, as many as labels and edges allow. The state is cut to shared
    storage each round.
    """
    kinds = sorted({r[0] for r in graphs.edges.select("label").distinct().collect()} | {black})
    labels = sorted({r[0] for r in graphs.nodes.select(F.coalesce("label", F.lit("#"))).distinct().collect()})
    learnt: list[Learnt] = []
    state = _start(graphs)
    key = state.schema["graph_id"].dataType.simpleString()

    def step(rules: list[Rule]):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                states, found = [], []
                for text in pdf.state:
                    g, done = _load(text)
                    g, new = compressed(g, rules, nonterminal, kinds, black)
                    states.append(_dump(g, done + new))
                    seen = {(json.dumps(m), json.dumps(sorted(i)), json.dumps(sorted(o))) for m, nodes in matches(g, nonterminal) for _, i, o in realised(g, nodes, kinds, black)}
                    found.append([{"motif": m, "ins": i, "outs": o} for m, i, o in sorted(seen)])
                yield pd.DataFrame({"graph_id": pdf.graph_id, "form": pdf.form, "state": states, "found": found})

        return run

    schema = STATE.format(key=key) + ", found array<struct<motif:string,ins:string,outs:string>>"
    state = cut(state.mapInPandas(step([]), schema))
    while True:
        found = state.select("graph_id", F.explode("found").alias("x")).select("graph_id", "x.*")
        best = found.groupBy("motif").agg(F.countDistinct("graph_id").alias("n")).orderBy(F.desc("n"), "motif").first()
        if not best:
            return learnt, state.drop("found")
        rows = found.where(F.col("motif") == best["motif"]).groupBy("ins", "outs").agg(F.count("*").alias("n")).collect()
        read = lambda t: frozenset(map(tuple, json.loads(t)))
        needs, bans = clique([(r["n"], read(r["ins"]), read(r["outs"])) for r in rows])
        names, edges = json.loads(best["motif"])
        rule = Rule(nonterminal, tuple(names), tuple(map(tuple, edges)), needs)
        upper = frozenset((mu, black, q, pos, d, d2) for mu in labels for q in kinds for pos in range(len(names)) for d in ("in", "out") for d2 in ("in", "out")) - bans
        learnt.append(Learnt(rule, upper, best["n"]))
        # earlier rules fit nowhere, and the new one only where its motif is: all other graphs stay as they are
        may = F.exists("found", lambda x: x["motif"] == best["motif"])  # noqa: B023
        changed = state.where(may).select("graph_id", "form", "state").mapInPandas(step([x.rule for x in learnt]), schema)
        state = cut(changed.unionByName(state.where(~may)))


def start_rules(left: DataFrame) -> DataFrame:
    """left_form, start (a graph as its nodes and edges), n_graphs: a start rule for each kind of what is left, however many graphs end in it."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [_load(s) for s in pdf.state]
            yield pd.DataFrame({"graph_id": pdf.graph_id, "form": pdf.form, "left_form": [g.form() for g, _ in made], "start": [_dump(g, []) for g, _ in made], "steps": [s for _, s in made]})

    key = left.schema["graph_id"].dataType.simpleString()
    return left.mapInPandas(run, f"graph_id {key}, form string, left_form string, start string, steps array<int>")


def derived(left: DataFrame, rules: list[Rule], nonterminal: str = "gray") -> DataFrame:
    """graph_id, n_nodes, n_edges, n_steps, same: each graph derived from its kind's start rule and its own rules in reverse, and whether that is the input."""
    rows = cut(start_rules(left))
    starts = rows.groupBy("left_form").agg(F.min("start").alias("first"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, form, first, steps in zip(pdf.graph_id, pdf.form, pdf["first"], pdf.steps, strict=True):
                g, _ = _load(first)
                for k in reversed(steps):
                    g, _, _ = apply(g, next(n for n, x in g.labels.items() if x == nonterminal), rules[k])
                out.append((i, len(g.labels), len(g.edges), len(steps), g.form() == form))
            yield pd.DataFrame(out, columns=["graph_id", "n_nodes", "n_edges", "n_steps", "same"])

    key = left.schema["graph_id"].dataType.simpleString()
    return rows.join(starts, "left_form").select("graph_id", "form", "first", "steps").mapInPandas(run, f"graph_id {key}, n_nodes long, n_edges long, n_steps long, same boolean")


def round_trip(graphs: Graphs, nonterminal: str = "gray") -> DataFrame:
    """derived() with the rules that the graphs teach."""
    learnt, left = learn(graphs, nonterminal)
    return derived(left, [x.rule for x in learnt], nonterminal)
