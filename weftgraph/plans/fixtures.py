"""Small grammars with known languages."""

from __future__ import annotations

import json

from weftgraph.operators.hypergraphs import hypergraph, rewrite_first
from weftgraph.operators.rewriting import Rule

NONTERMINALS = {"gray", "black"}


def grammar(start: str, arity: dict[str, int | None], rules: list[tuple[str, dict]]) -> dict:
    """A grammar from symbols with their arity (None: terminal) and rules."""
    return {"N": [s for s, a in arity.items() if a is not None], "T": [s for s, a in arity.items() if a is None], "S": start, "vocab": arity, "counts": [0] * len(rules), "rules": [{"symbol": s, "vocab": arity, "rhs": r} for s, r in rules]}


def path(word: str) -> dict:
    """A word as a path between two externals."""
    names = ["e0", *[f"n{k}" for k in range(len(word) - 1)], "e1"]
    return hypergraph(len(word) - 1, 2, [([a, b], x) for a, b, x in zip(names, names[1:], word, strict=False)])


def cycle(word: str) -> dict:
    return hypergraph(len(word), 0, [([f"n{k}", f"n{(k + 1) % len(word)}"], x) for k, x in enumerate(word)])


def derived(g: dict, start: dict, steps: list[int]) -> dict:
    for k in steps:
        start = rewrite_first(start, g["rules"][k])
    return start


# Fixed test values: the rules of five small grammars.
POINT = grammar("S", {"S": 0, "a": None}, [("S", hypergraph(0, 0, [([], "a")]))])
ABC = grammar(
    "S",
    {"S": 2, "A": 4, "a": None, "b": None, "c": None},
    [
        ("S", hypergraph(4, 2, [(["e0", "n0"], "a"), (["n1", "n2"], "b"), (["n2", "n3"], "c"), (["n0", "n1", "n3", "e1"], "A")])),
        ("S", hypergraph(2, 2, [(["e0", "n0"], "a"), (["n0", "n1"], "b"), (["n1", "e1"], "c")])),
        ("A", hypergraph(3, 4, [(["e0", "n0"], "a"), (["n1", "e1"], "b"), (["e2", "n2"], "c"), (["n0", "n1", "n2", "e3"], "A")])),
        ("A", hypergraph(1, 4, [(["e0", "n0"], "a"), (["n0", "e1"], "b"), (["e2", "e3"], "c")])),
    ],
)
ENDS = grammar(
    "S",
    {"S": 0, "A": 1, "a": None, "b": None, "c": None},
    [("S", hypergraph(2, 0, [(["n0", "n1"], "a"), (["n1"], "A")])), ("A", hypergraph(3, 1, [(["e0", "n0"], "b"), (["n0", "n1"], "c"), (["n1", "n2"], "a")]))],
)
CYCLE = grammar(
    "S",
    {"S": 0, "A": 2, "a": None, "b": None},
    [
        ("S", hypergraph(4, 0, [(["n0", "n1"], "A"), (["n1", "n2"], "A"), (["n2", "n3"], "a"), (["n3", "n0"], "b")])),
        ("A", hypergraph(2, 2, [(["e0", "n0"], "a"), (["n0", "n1"], "b"), (["n1", "e1"], "A")])),
        ("A", hypergraph(1, 2, [(["e0", "n0"], "a"), (["n0", "e1"], "b")])),
    ],
)
RUBBER = grammar(
    "RUBBER",
    {"RUBBER": 0, "SECTION1": 1, "SECTION2": 1, "CHAIN": 2, "SECTION": 2, "CH3": 1, "CH2": 2, "CH": 2, "C": None, "H": None},
    [
        ("RUBBER", hypergraph(2, 0, [(["n0"], "SECTION1"), (["n0", "n1"], "CHAIN"), (["n1"], "SECTION2")])),
        ("RUBBER", hypergraph(1, 0, [(["n0"], "SECTION1"), (["n0"], "SECTION2")])),
        ("CHAIN", hypergraph(1, 2, [(["e0", "n0"], "SECTION"), (["n0", "e1"], "CHAIN")])),
        ("CHAIN", hypergraph(0, 2, [(["e0", "e1"], "SECTION")])),
        ("SECTION1", hypergraph(4, 1, [(["n0"], "CH3"), (["n1"], "CH3"), (["n0", "n1", "n2"], "C"), (["n2", "n3"], "CH"), (["n3", "e0"], "CH2")])),
        ("SECTION", hypergraph(4, 2, [(["e0", "n0"], "CH2"), (["n1"], "CH3"), (["n0", "n1", "n2"], "C"), (["n2", "n3"], "CH"), (["n3", "e1"], "CH2")])),
        ("SECTION2", hypergraph(4, 1, [(["e0", "n0"], "CH2"), (["n1"], "CH3"), (["n0", "n1", "n2"], "C"), (["n2", "n3"], "CH"), (["n3"], "CH3")])),
        ("CH3", hypergraph(1, 1, [(["e0", "n0"], "CH2"), (["n0"], "H")])),
        ("CH2", hypergraph(2, 2, [(["e0", "e1", "n0", "n1"], "C"), (["n0"], "H"), (["n1"], "H")])),
        ("CH", hypergraph(1, 2, [(["e0", "e1", "n0"], "C"), (["n0"], "H")])),
    ],
)


def membership_cases() -> list[tuple[str, str, list[tuple[str, bool]]]]:
    """Name, grammar and hypergraphs (as JSON) with whether they are members."""
    long = derived(ABC, hypergraph(0, 2, [(["e0", "e1"], "S")]), [0, *[2] * 9, 3])
    polymer = derived(RUBBER, hypergraph(0, 0, [([], "RUBBER")]), [0, 2, 3, 4, 5, 5, 6, *[7] * 6, *[8] * 12, *[9] * 4])
    matching = hypergraph(5, 0, [(["n0", "n1"], "a"), (["n1", "n2"], "c"), (["n2", "n3"], "b"), (["n4", "n3"], "a")])
    cases = [
        ("point", POINT, [(hypergraph(0, 0, [([], "a")]), True), (hypergraph(1, 0, [(["n0"], "a")]), False)]),
        ("abc", ABC, [(long, True)] + [(path(w), m) for w, m in (("ab", False), ("abc", True), ("abcabc", False), ("aabbcc", True), ("abbc", False))]),
        ("ends", ENDS, [(matching, True)]),
        ("cycle", CYCLE, [(cycle(w), m) for w, m in (("abab", False), ("ababab", True), ("bababa", True), ("aabbab", False))]),
        ("rubber", RUBBER, [(polymer, True)]),
    ]
    return [(name, json.dumps(g), [(json.dumps(h), m) for h, m in tests]) for name, g, tests in cases]


def house_rules() -> list[Rule]:
    """Start, middle and end of a row of houses: three, four and four cyan nodes, a gray one while it goes on.

    Neighbours of the gray node are joined to the first new node (walls) and the second one (roofs).
    """
    walls = frozenset({("cyan", "blue", "blue", 0, d, d) for d in ("in", "out")} | {("cyan", "green", "green", 1, d, d) for d in ("in", "out")})
    # Fixed test values: labels, edges and instructions of the three rules.
    start = Rule("black", ("cyan", "cyan", "cyan", "gray"), ((0, 1, "red"), (1, 2, "red"), (1, 3, "blue"), (2, 3, "green")))
    body = ((0, 1, "red"), (1, 2, "red"), (2, 3, "red"), (3, 0, "red"))
    middle = Rule("gray", ("cyan",) * 4 + ("gray",), (*body, (2, 4, "blue"), (3, 4, "green")), walls)
    return [start, middle, Rule("gray", ("cyan",) * 4, body, walls)]


def palindromes(labels: list[str], joined: str = "black") -> dict:
    """A grammar of paths whose labels read the same from both ends, grown from the middle outward."""
    from weftgraph.operators.hypergraphs import hypergraph

    rules = [("S", hypergraph(1, 0, [(["n0"], x)])) for x in labels]
    for x in labels:
        out = [(["n0"], x), (["n1"], x), (["n0", "e0"], joined), (["e1", "n1"], joined)]
        even, more = [(["n0"], x), (["n1"], x), (["n0", "n1"], joined)], [(["n0", "n1"], "P")]
        rules += [("P", hypergraph(2, 2, out)), ("P", hypergraph(2, 2, out + more)), ("S", hypergraph(2, 0, even)), ("S", hypergraph(2, 0, even + more))]
        for y in labels:
            odd = [(["n2"], y), (["n0"], x), (["n1"], x), (["n0", "n2"], joined), (["n2", "n1"], joined)]
            rules += [("S", hypergraph(3, 0, odd)), ("S", hypergraph(3, 0, odd + more))]
    return {"N": ["S", "P"], "S": "S", "rules": [{"symbol": s, "rhs": r} for s, r in rules]}
