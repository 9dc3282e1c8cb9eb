"""Undirected grammars: node-label and neighbourhood controlled embedding."""

from __future__ import annotations

import random
from dataclasses import dataclass

from weftgraph.operators.traversal import canonical


@dataclass(frozen=True)
class PlainRule:
    """What stands in a nonterminal's place. embedding: (x, y) joins new nodes x to neighbours labelled y.

    by_label: x is a new node's label, otherwise its position.
    """

    symbol: str
    labels: tuple[str, ...]
    edges: tuple[tuple[int, int], ...]
    embedding: frozenset[tuple] = frozenset()
    by_label: bool = True


@dataclass
class Plain:
    """An undirected graph; edges are pairs in order."""

    labels: dict[int, str]
    edges: set[tuple[int, int]]

    def near(self, nodes: set[int]) -> set[int]:
        return {b for a, b in self.edges if a in nodes and b not in nodes} | {a for a, b in self.edges if b in nodes and a not in nodes}

    def form(self) -> str:
        return canonical(self.labels, [(a, b, "") for a, b in self.edges] + [(b, a, "") for a, b in self.edges])


def _pair(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a < b else (b, a)


def apply(g: Plain, node: int, rule: PlainRule) -> Plain:
    first = max(g.labels) + 1
    new = range(first, first + len(rule.labels))
    edges = {e for e in g.edges if node not in e} | {_pair(first + a, first + b) for a, b in rule.edges}
    for y in g.near({node}):
        for k, x in zip(new, rule.labels, strict=True):
            if ((x if rule.by_label else k - first), g.labels[y]) in rule.embedding:
                edges.add(_pair(k, y))
    return Plain({n: x for n, x in g.labels.items() if n != node} | dict(zip(new, rule.labels, strict=True)), edges)


def instructions(g: Plain, match: list[int], by_label: bool = True) -> tuple[set, set]:
    """Pairs that a match needs, and those that it forbids, as its neighbours have or lack the edges."""
    ins, outs = set(), set()
    for y in g.near(set(match)):
        for k, n in enumerate(match):
            (ins if _pair(n, y) in g.edges else outs).add((g.labels[n] if by_label else k, g.labels[y]))
    return ins, outs


def compatible(a: tuple[set, set], b: tuple[set, set]) -> bool:
    """Whether one rule can serve both: none needs what either forbids."""
    return not (a[0] | b[0]) & (a[1] | b[1])


def contract(g: Plain, match: list[int], label: str) -> Plain:
    """The match as one node, joined to all its neighbours."""
    inside, new = set(match), min(match)
    edges = {e for e in g.edges if not inside & set(e)} | {_pair(new, y) for y in g.near(inside)}
    return Plain({n: x for n, x in g.labels.items() if n not in inside} | {new: label}, edges)


def contract_all(g: Plain, matches: list[list[int]], label: str, nonterminals: set[str]) -> tuple[Plain, list[int]]:
    """Matches contracted one by one, without those that overlap an earlier one or join two nonterminals; and which were."""
    done, gone = [], set()
    for k, m in enumerate(matches):
        if gone & set(m):
            continue
        new = contract(g, m, label)
        if not any(new.labels[a] in nonterminals and new.labels[b] in nonterminals for a, b in new.edges):
            g = new
            done.append(k)
            gone |= set(m)
    return g, done


def extract(g: Plain, matches: list[list[int]], symbol: str, by_label: bool = True) -> PlainRule:
    """A rule that serves compatible matches: its embedding is what they need together."""
    m = matches[0]
    edges = tuple((i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if _pair(m[i], m[j]) in g.edges)
    return PlainRule(symbol, tuple(g.labels[n] for n in m), edges, frozenset().union(*(instructions(g, x, by_label)[0] for x in matches)), by_label)


def sample(rules: list[PlainRule], nonterminals: set[str], seed: int, start: str = "black", steps: int = 100) -> Plain | None:
    """A random derivation, or None if it doesn't end in so many steps."""
    rng, g = random.Random(seed), Plain({0: start}, set())
    for _ in range(steps):
        left = sorted(n for n, x in g.labels.items() if x in nonterminals)
        if not left:
            return g
        node = rng.choice(left)
        fit = [r for r in rules if r.symbol == g.labels[node]]
        if not fit:
            return None
        g = apply(g, node, rng.choice(fit))
    return None
