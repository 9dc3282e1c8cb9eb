"""Searches inside one small structure: cliques, hitting sets, spanning trees, chordal completion."""

from __future__ import annotations

import heapq
import random
from collections.abc import Hashable, Iterable


def greedy_clique(near: dict[Hashable, set]) -> list:
    """Nodes by falling degree, each taken if it is joined to all taken; ties to smaller ids."""
    out: list = []
    for n in sorted(near, key=lambda n: (-len(near[n]), str(n))):
        if all(n in near[o] for o in out):
            out.append(n)
    return out


def random_clique(near: dict[Hashable, set], seed: int, tries: int = 10) -> list:
    """The largest of some maximal cliques grown in random order; ties to the earlier try."""
    best: list = []
    for k in range(tries):
        rng, out, left = random.Random(seed * 1009 + k), [], sorted(near, key=str)
        while left:
            n = rng.choice(left)
            out.append(n)
            left = [x for x in left if x in near[n]]
        if len(out) > len(best):
            best = out
    return best


def best_clique(near: dict[Hashable, set], cost: dict[Hashable, int] | None = None, limit: int = 2000, seed: int = 0) -> list:
    """A large clique of each component, and of those the largest; ties to the least cost. Beyond limit nodes greedily."""
    left, found = set(near), []
    while left:
        part, front = set(), [left.pop()]
        while front:
            n = front.pop()
            part.add(n)
            new = near[n] & left
            left -= new
            front += new
        own = {n: near[n] & part for n in part}
        found.append(max([greedy_clique(own)] + ([random_clique(own, seed)] if len(own) <= limit else []), key=len))
    return min(found, key=lambda c: (-len(c), sum((cost or {}).get(n, 0) for n in c), sorted(map(str, c))), default=[])


def hitting_set(sets: Iterable[Iterable[int]], beam: int = 100) -> list[int]:
    """A small set that meets each of sets, by beam search; exact if the beam never overflows. Ties to the smaller sorted set."""
    wanted = [frozenset(s) for s in sets]
    if not all(wanted):
        raise ValueError("an empty set can't be hit")
    states: list[tuple[int, ...]] = [()]
    while True:
        done = [s for s in states if all(w & set(s) for w in wanted)]
        if done:
            return list(min(done))
        new = set()
        for s in states:
            first = next(w for w in wanted if not w & set(s))
            new |= {tuple(sorted({*s, x})) for x in first}
        states = heapq.nsmallest(beam, new, key=lambda s: (sum(not w & set(s) for w in wanted), s))


def spanning_tree(nodes: Iterable, edges: Iterable[tuple], heaviest: bool = True) -> list[tuple]:
    """Edges (a, b, weight) of a spanning forest of the greatest (or least) weight; ties in the order of names."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    out = []
    for a, b, w in sorted(edges, key=lambda e: (-e[2] if heaviest else e[2], str(e[0]), str(e[1]))):
        if top(a) != top(b):
            up[top(a)] = top(b)
            out.append((a, b, w))
    return out


def maximal_cliques(near: dict[Hashable, set]) -> list[tuple]:
    """All maximal cliques, each sorted, in order."""
    out = []

    def grow(taken: list, left: set, gone: set) -> None:
        if not left and not gone:
            out.append(tuple(sorted(taken)))
            return
        pivot = max(left | gone, key=lambda n: len(near[n] & left))
        for n in sorted(left - near[pivot], key=str):
            grow([*taken, n], left & near[n], gone & near[n])
            left, gone = left - {n}, gone | {n}

    grow([], set(near), set())
    return sorted(out)


def clique_tree(near: dict[Hashable, set]) -> tuple[list[tuple], list[tuple]]:
    """The maximal cliques, and edges (i, j, overlap) of a tree of the greatest overlaps between them."""
    cliques = maximal_cliques(near)
    pairs = [(i, j, len(set(a) & set(b))) for i, a in enumerate(cliques) for j, b in enumerate(cliques) if i < j and set(a) & set(b)]
    return cliques, spanning_tree(range(len(cliques)), pairs)


def chordal(near: dict[Hashable, set]) -> bool:
    """Whether every cycle of over three nodes has a chord: nodes can go one by one, each with neighbours that are all joined."""
    near = {n: set(v) for n, v in near.items()}
    while near:
        n = next((n for n in sorted(near, key=str) if all(b in near[a] for a in near[n] for b in near[n] if a != b)), None)
        if n is None:
            return False
        for b in near.pop(n):
            near[b].discard(n)
    return True


def complete(near: dict[Hashable, set], rings: list[list]) -> dict[Hashable, set]:
    """Rings that two bonds of a chordless cycle belong to are joined throughout, until the graph is chordal or no ring is left."""
    near = {n: set(v) for n, v in near.items()}
    for ring in sorted(rings, key=lambda r: (len(r), sorted(map(str, r)))):
        if chordal(near):
            break
        for a in ring:
            near[a] |= set(ring) - {a}
    return near


def disambiguate(derivations: list[list[int]], allowed: set[int]) -> tuple[list[int], list[int]] | None:
    """Of several derivations of a graph one to keep, and the fewest rules whose removal leaves it alone.

    Rules that the kept one uses, or that aren't allowed to go, stay. None if no derivation can be singled out.
    """
    best = None
    sets = [frozenset(d) for d in derivations]
    for k, own in enumerate(sets):
        others = [s for j, s in enumerate(sets) if j != k]
        gone = [(s - own) & allowed for s in others]
        if all(gone):
            hit = hitting_set(gone) if gone else []
            if best is None or (len(hit), k) < (len(best[1]), best[2]):
                best = (derivations[k], hit, k)
    return best and (best[0], best[1])
