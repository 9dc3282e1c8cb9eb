"""Questions to a hyperedge replacement grammar inside a task: rules compiled once, edges as bits, answers kept for all hypergraphs that the task is given.

A question is a symbol, edges of a hypergraph as the bits of a number, and the nodes that the symbol's externals lie on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

#: Edges of questions whose answers a task keeps, about 200 bytes each.
KEPT = 500_000

Question = tuple[str, int, tuple]


@dataclass(frozen=True)
class Laying:
    """What rules share that differ in their nonterminal edges only: these are laid once. rules: nonterminal edges (label, nodes) of each, and the least number of edges that they derive."""

    ext: tuple
    inner: tuple
    terminal: tuple
    need: dict
    rules: list


@dataclass
class Open:
    """A question that is open: the ways not tried yet, the questions left of the one that is tried (None: none is), the depth of the outermost open question that it leans on."""

    key: tuple
    ways: Iterator[list[Question]]
    low: int
    left: list[Question] | None = None


class Host:
    """A hypergraph by bits: of has the edges by label and number of nodes, touch those by node."""

    def __init__(self, hg: dict):
        self.ids = list(dict.fromkeys([*(v["id"] for v in hg["V"]), *(n for e in hg["E"] for n in e["nodes"])]))
        place = {n: k for k, n in enumerate(self.ids)}
        self.edges, self.labels = hg["E"], [e["label"] for e in hg["E"]]
        self.sets = [frozenset(place[n] for n in e["nodes"]) for e in hg["E"]]
        self.of: dict = defaultdict(int)
        self.touch: dict = defaultdict(int)
        for k, (label, nodes) in enumerate(zip(self.labels, self.sets, strict=True)):
            self.of[label, len(nodes)] |= 1 << k
            for n in nodes:
                self.touch[n] |= 1 << k
        self.ext = tuple(place[n] for n in hg["ext"])
        self.every = (1 << len(self.edges)) - 1
        self.alone = () if self.ext else tuple(place[v["id"]] for v in hg["V"] if place[v["id"]] not in self.touch)  # nodes without edges; rules of a hypergraph's parts don't reach them
        self.keys: dict = {}

    def nodes(self, mask: int) -> set:
        return set().union(*(self.sets[e] for e in bits(mask)))

    def key(self, symbol: str, mask: int, ext: tuple, alone: tuple = ()) -> tuple:
        """Equal questions are isomorphic: nodes are numbered by their order, externals first. Edges match by their sets of nodes, so these do."""
        if (found := self.keys.get((symbol, mask, ext, alone))) is None:
            number: dict = {}
            for n in (*ext, *sorted(self.nodes(mask))):
                number.setdefault(n, len(number))
            edges = tuple(sorted((self.labels[e], tuple(sorted(number[n] for n in self.sets[e]))) for e in bits(mask)))
            found = self.keys[symbol, mask, ext, alone] = (symbol, tuple(number[n] for n in ext), edges, len(alone))
        return found

    def parts(self, mask: int, cut: set) -> list[tuple[int, set]]:
        """Edges joined through nodes outside cut, and the cut nodes that each part touches."""
        out = []
        while mask:
            part, front, touched = 0, mask & -mask, set()
            while front:
                part |= front
                nodes = self.nodes(front)
                touched |= nodes & cut
                front = 0
                for n in nodes - cut:
                    front |= self.touch[n]
                front &= mask & ~part
            mask &= ~part
            out.append((part, touched))
        return out

    def hypergraph(self, mask: int, ext: tuple) -> dict:
        """The edges of mask alone, with their nodes and ext."""
        own, ends = [self.edges[e] for e in bits(mask)], [self.ids[n] for n in ext]
        return {"V": [{"id": n} for n in dict.fromkeys([*ends, *(n for e in own for n in e["nodes"])])], "E": own, "ext": ends}


def bits(mask: int) -> Iterator[int]:
    while mask:
        yield (mask & -mask).bit_length() - 1
        mask &= mask - 1


def joined_first(edges: list[dict], placed: set) -> list[dict]:
    """Edges in an order in which each, if it can, touches nodes that are placed already."""
    placed, left, out = set(placed), list(edges), []
    while left:
        e = min(left, key=lambda e: (not placed & set(e["nodes"]), len(set(e["nodes"]) - placed), -len(e["nodes"])))  # noqa: B023
        left.remove(e)
        out.append(e)
        placed |= set(e["nodes"])
    return out


class Search:
    def __init__(self, grammar: dict):
        self.nonterminals = set(grammar["N"])
        #: No symbol derives fewer edges.
        self.least: dict = defaultdict(lambda: float("inf"))
        sides = [(r["symbol"], r["rhs"], [e for e in r["rhs"]["E"] if e["label"] not in self.nonterminals], [e for e in r["rhs"]["E"] if e["label"] in self.nonterminals]) for r in grammar["rules"]]
        fewer = True
        while fewer:
            fewer = False
            for symbol, _, terminal, open_edges in sides:
                if (n := len(terminal) + sum(self.least[e["label"]] for e in open_edges)) < self.least[symbol]:
                    self.least[symbol], fewer = n, True
        found: dict = {}
        for symbol, rhs, terminal, open_edges in sides:
            ext, inner = tuple(rhs["ext"]), tuple(v["id"] for v in rhs["V"] if v["id"] not in rhs["ext"])
            edges = tuple(((e["label"], len(set(e["nodes"]))), tuple(dict.fromkeys(e["nodes"]))) for e in joined_first(terminal, set(ext)))
            laying = found.setdefault((symbol, ext, inner, edges), Laying(ext, inner, edges, Counter(kind for kind, _ in edges), []))
            least = sum(self.least[e["label"]] for e in open_edges)
            if least < float("inf"):
                laying.rules.append(([(e["label"], tuple(e["nodes"])) for e in open_edges], least))
        self.layings: dict = defaultdict(list)
        for (symbol, ext, *_), laying in found.items():
            if laying.rules:
                self.layings[symbol, len(ext)].append(laying)
        self.known: dict = {}
        self.held = 0

    def answer(self, symbol: str, hg: dict, steps: int) -> bool | None:
        """Whether symbol derives hg, exactly; None if so many steps don't tell. The first way that holds ends a question."""
        host = Host(hg)
        if self.nonterminals & set(host.labels):
            return False
        if self.held > KEPT:
            self.known.clear()
            self.held = 0
        asked: dict = {}  # depth of the open questions, each inside the one before
        stack: list[Open] = []

        def ask(symbol: str, mask: int, ext: tuple, alone: tuple = ()) -> tuple[bool, int] | None:
            """The answer, and the depth of the outermost open question that it leans on; None if the question is open now."""
            key = host.key(symbol, mask, ext, alone)
            if key in self.known:
                return self.known[key], len(asked)
            if key in asked:  # a shortest derivation never asks this inside itself
                return False, asked[key]
            asked[key] = len(asked)
            stack.append(Open(key, self.split(host, symbol, mask, ext, alone), len(stack)))
            return None

        told = ask(symbol, host.every, host.ext, host.alone)
        while stack:
            top, depth = stack[-1], len(stack) - 1
            if told:
                top.low = min(top.low, told[1])
                top.left = top.left if told[0] else None
                told = None
            if top.left:
                told = ask(*top.left.pop())
            elif top.left is None and (way := next(top.ways, None)) is not None:
                if not steps:
                    return None
                steps -= 1
                top.left = sorted(way, key=lambda q: -q[1].bit_count())  # the smallest is asked first
            else:
                told = (True, depth) if top.left is not None else (False, top.low)
                if told[0] or top.low >= depth:
                    self.keep(top.key, told[0])
                del asked[top.key]
                stack.pop()
        return told[0]

    def keep(self, key: tuple, answer: bool) -> None:
        self.known[key] = answer
        self.held += len(key[2]) + 1

    def ways(self, symbol: str, hg: dict) -> Iterator[list[tuple[str, dict]]]:
        """The questions (symbol, hypergraph) that are left for each way to begin a derivation of hg by a rule of symbol; without those whose answer is known."""
        host = Host(hg)
        if self.nonterminals & set(host.labels):
            return
        for way in self.split(host, symbol, host.every, host.ext, host.alone):
            known = [self.known.get(host.key(*question)) for question in way]
            if False not in known:
                yield [(s, host.hypergraph(mask, ext)) for (s, mask, ext), answer in zip(way, known, strict=True) if not answer]

    def split(self, host: Host, symbol: str, mask: int, ext: tuple, alone: tuple) -> Iterator[list[Question]]:
        """The questions left for each way to begin by a rule of symbol."""
        for laying in self.layings.get((symbol, len(ext)), ()):
            if any((mask & host.of.get(kind, 0)).bit_count() < n for kind, n in laying.need.items()):
                continue
            for at, used in laid(host, laying, mask, ext, alone):
                rest, parts = mask & ~used, None
                for buckets, least in laying.rules:
                    if not buckets:
                        if not rest:
                            yield []
                        continue
                    if rest.bit_count() < least:
                        continue
                    if parts is None:
                        parts = host.parts(rest, set(at.values()))
                    ends = [tuple(at[n] for n in names) for _, names in buckets]
                    options = [[k for k, own in enumerate(ends) if touched <= set(own)] for _, touched in parts]
                    for chosen in product(*options) if all(options) else ():
                        owned = [0] * len(buckets)
                        for (part, _), k in zip(parts, chosen, strict=True):
                            owned[k] |= part
                        if all(o.bit_count() >= self.least[label] for (label, _), o in zip(buckets, owned, strict=True)):
                            yield [(label, o, x) for (label, _), o, x in zip(buckets, owned, ends, strict=True)]


def laid(host: Host, laying: Laying, mask: int, ext: tuple, alone: tuple) -> Iterator[tuple[dict, int]]:
    """(nodes by name, edges used): the ways to lay terminal edges on distinct edges of the same label and node set, with the externals at ext and all other nodes on any."""
    outside = set(ext)

    def edges(k: int, at: dict, used: int) -> Iterator[tuple[dict, int]]:
        if k == len(laying.terminal):
            yield from free([n for n in laying.inner if n not in at], at, used)
            return
        kind, names = laying.terminal[k]
        fit = mask & ~used & host.of.get(kind, 0)
        for n in names:
            if n in at:
                fit &= host.touch.get(at[n], 0)
        for e in bits(fit):
            for more in fits(names, host.sets[e], at):
                yield from edges(k + 1, more, used | 1 << e)

    def fits(names: tuple, have: frozenset, at: dict) -> Iterator[dict]:
        if not names:
            yield at
            return
        first, rest = names[0], names[1:]
        if first in at:
            if at[first] in have:
                yield from fits(rest, have - {at[first]}, at)
            return
        for n in have:
            if n not in outside and n not in at.values():
                yield from fits(rest, have - {n}, {**at, first: n})

    def free(names: list, at: dict, used: int) -> Iterator[tuple[dict, int]]:
        if not names:
            yield at, used
            return
        for n in sorted(host.nodes(mask) - outside) + [*alone]:
            if n not in at.values():
                yield from free(names[1:], {**at, names[0]: n}, used)

    yield from edges(0, dict(zip(laying.ext, ext, strict=True)), 0)
