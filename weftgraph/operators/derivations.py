"""All derivations of a graph, and making a grammar unambiguous."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import pandas as pd
from pyspark.sql import DataFrame

from weftgraph.operators.rewriting import Graph, Instruction, Rule, apply, connected
from weftgraph.operators.search import disambiguate


def _effects(rule: Rule) -> dict[tuple, frozenset]:
    """For each (mu, p, d) that a neighbour can have: the edges (pos, q, d2) that it gets."""
    out: dict = {}
    for mu, p, q, pos, d, d2 in rule.embedding:
        out.setdefault((mu, p, d), set()).add((pos, q, d2))
    return {k: frozenset(v) for k, v in out.items()}


def unapplied(g: Graph, rule: Rule) -> Iterator[Graph]:
    """Each graph that the rule turns into g, by one of its nodes, which is named like the least it stands for.

    The new nodes are laid on g with exactly the rule's edges among them. A
    neighbour must have come by one edge to the replaced node, so all its edges to
    the new nodes are what one (label, edge, direction) of the embedding makes.
    """
    effects = _effects(rule)
    joined = {}
    for a, b, x in g.edges:
        joined.setdefault((a, b), set()).add(x)
    by_label: dict = {}
    for n, x in g.labels.items():
        by_label.setdefault(x, []).append(n)
    want = {(a, b): {x for c, d, x in rule.edges if (c, d) == (a, b)} for a, b in permutations(range(len(rule.labels)), 2)}

    def laid(at: tuple) -> Iterator[tuple]:
        k = len(at)
        if k == len(rule.labels):
            yield at
            return
        for n in by_label.get(rule.labels[k], ()):
            if n not in at and all(joined.get((m, n), set()) == want[j, k] and joined.get((n, m), set()) == want[k, j] for j, m in enumerate(at)):
                yield from laid((*at, n))

    for at in laid(()):
        place = {n: k for k, n in enumerate(at)}
        outside: dict = {}
        for a, b, x in g.edges:
            if (a in place) != (b in place):
                y, edge = (b, (place[a], x, "out")) if a in place else (a, (place[b], x, "in"))
                outside.setdefault(y, set()).add(edge)
        ways = [[(y, p, d) for (mu, p, d), e in effects.items() if mu == g.labels[y] and e == frozenset(edges)] for y, edges in outside.items()]
        rest = {e for e in g.edges if e[0] not in place and e[1] not in place}
        new = min(at)
        for chosen in product(*ways):
            yield Graph({n: x for n, x in g.labels.items() if n not in place} | {new: rule.symbol}, rest | {(new, y, p) if d == "out" else (y, new, p) for y, p, d in chosen})


def derivations(g: Graph, rules: list[Rule], nonterminals: set[str], start: str = "black", most: int = 10_000) -> list[list[int]]:
    """All rule sequences that derive g, with one nonterminal at a time, in order. Raises beyond so many states.

    States are kept by canonical form, so a graph that several ways lead to is taken apart once.
    """
    known: dict[str, set[tuple]] = {}

    def of(h: Graph) -> set[tuple]:
        form = h.form()
        if form not in known:
            if len(known) >= most:
                raise RuntimeError(f"over {most} states")
            known[form] = {()} if list(h.labels.values()) == [start] and not h.edges else set()
            for k, rule in enumerate(rules):
                # only the nonterminal that the rule brought may be left
                if sum(x in nonterminals for x in h.labels.values()) == sum(x in nonterminals for x in rule.labels):
                    for before in unapplied(h, rule):
                        if connected(before):
                            known[form] |= {(*s, k) for s in of(before)}
        return known[form]

    return sorted(map(list, of(g)))


def all_derivations(graphs: DataFrame, rules: list[Rule], nonterminals: set[str]) -> DataFrame:
    """graphs(graph_id, nodes ARRAY<STRUCT<node_id, label>>, edges ARRAY<STRUCT<src, dst, label>>): graph_id, derivations, problem."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, n, e in zip(pdf.graph_id, pdf.nodes, pdf.edges, strict=True):
                g = Graph({x["node_id"]: x["label"] for x in n}, {(x["src"], x["dst"], x["label"]) for x in (e if e is not None else ())})
                try:
                    out.append((i, derivations(g, rules, nonterminals), None))
                except RuntimeError as x:
                    out.append((i, [], str(x)))
            yield pd.DataFrame(out, columns=["graph_id", "derivations", "problem"])

    return graphs.select("graph_id", "nodes", "edges").mapInPandas(run, "graph_id long, derivations array<array<int>>, problem string")


def resolve(found: list[tuple[int, int, list[list[int]]]]) -> tuple[set[int], dict[int, list[int]], list[int]]:
    """Rules to delete so that each graph(id, size, derivations) has one derivation, what each then has, and those that lost all.

    Graphs are settled from the smallest; rules that a settled graph uses stay. By
    nature a sequential choice, over derivations that all_derivations() made in parallel.
    """
    gone: set[int] = set()
    kept: set[int] = set()
    settled: dict[int, list[int]] = {}
    for i, _, ways in sorted(found, key=lambda x: (x[1], x[0])):
        left = [w for w in ways if not gone & set(w)]
        if len(left) > 1:
            choice = disambiguate(left, {k for w in left for k in w} - kept)
            if choice:
                gone |= set(choice[1])
                left = [choice[0]]
        if left:
            settled[i] = left[0]
            kept |= set(left[0])
    return gone, settled, sorted(i for i, _, ways in found if i not in settled)


def orders(children: dict[int, list[int]], root: int) -> list[list[int]]:
    """All orders in which a parse tree's nodes can be expanded: parents first, children in any order one after the other."""
    if not children.get(root):
        return [[root]]
    out = []
    for p in permutations(children[root]):
        for parts in product(*(orders(children, c) for c in p)):
            out.append([root, *(n for part in parts for n in part)])
    return out


def variants(rules: list[Rule], sequences: list[list[int]], nonterminals: set[str]) -> list[tuple[list[int], Graph]]:
    """The different graphs among those that some orders of rules derive; the first order of each."""
    from weftgraph.operators.rewriting import derive

    seen: dict[str, tuple] = {}
    for s in sequences:
        try:
            g = derive(rules, s, nonterminals)
        except ValueError:
            continue
        seen.setdefault(g.form(), (s, g))
    return list(seen.values())


def round_trip(g: Graph, sequence: list[int], rules: list[Rule], nonterminals: set[str]) -> bool:
    """Whether a derivation gives back the graph."""
    from weftgraph.operators.rewriting import derive

    return derive(rules, sequence, nonterminals).form() == g.form()


def applied(sequence: list[int], rules: list[Rule], nonterminals: set[str], start: str = "black") -> list[tuple[int, list[int], set[Instruction]]]:
    """For each step of a derivation the rule, the new nodes and the instructions that took effect."""
    g, out = Graph({0: start}, set()), []
    for k in sequence:
        node = next(n for n, x in g.labels.items() if x in nonterminals)
        g, new, used = apply(g, node, rules[k])
        out.append((k, new, used))
    return out
