"""Tests on amplifier circuits and the text form of their topology."""

from __future__ import annotations

from collections.abc import Iterator

from weftgraph.operators.masks import reachable
from weftgraph.operators.rewriting import Graph

# Codes of cell types in the text form.
CODES = {"input": 0, "output": 1, "R": 2, "C": 3, "+gm+": 6, "-gm+": 7, "+gm-": 8, "-gm-": 9}


def _after(g: Graph) -> dict[int, list[int]]:
    out: dict = {n: [] for n in g.labels}
    for a, b, _ in sorted(g.edges):
        out[a].append(b)
    return out


def simple_paths(g: Graph, a: int, b: int) -> Iterator[list[int]]:
    """All paths without a repeated node."""
    after = _after(g)

    def walk(path: list[int]) -> Iterator[list[int]]:
        if path[-1] == b:
            yield path
            return
        for n in after[path[-1]]:
            if n not in path:
                yield from walk([*path, n])

    yield from walk([a])


def trimmed(g: Graph, loose: bool = True, source: str = "input", sink: str = "output") -> Graph:
    """g without what isn't on the way from the source to the sink.

    loose keeps every edge between nodes that the source reaches and that reach the
    sink. Otherwise only edges that one depth-first search keeps: those to the sink, and
    tree edges above one kept; nodes seen before add nothing.
    """
    starts, ends = ({n for n, x in g.labels.items() if x == label} for label in (source, sink))
    if loose:
        both = reachable(g, starts) & reachable(g, ends, back=True)
        return Graph({n: x for n, x in g.labels.items() if n in both}, {e for e in g.edges if e[0] in both and e[1] in both})
    after, seen, kept = _after(g), set(), set()

    def search(n: int) -> bool:
        seen.add(n)
        hit = False
        for b in after[n]:
            if b in ends or (b not in seen and search(b)):
                kept.add((n, b))
                hit = True
        return hit

    search(min(starts))
    used = {n for e in kept for n in e}
    return Graph({n: x for n, x in g.labels.items() if n in used}, {e for e in g.edges if e[:2] in kept})


def main_path(g: Graph, source: str = "input", sink: str = "output") -> tuple[list[int], int]:
    """The path with the most gain cells, the shortest of those, and their number."""
    a, b = (next(n for n, x in sorted(g.labels.items()) if x == label) for label in (source, sink))
    rated = [(-sum("gm" in g.labels[n] for n in p), len(p), p) for p in simple_paths(g, a, b)]
    if not rated:
        return [], 0
    stages, _, path = min(rated)
    return path, -stages


def numbered(g: Graph) -> tuple[dict[int, int], int]:
    """New numbers: 0 the input, 1 the output, then the main path, then the rest; and the number of stages.

    Raises ValueError unless there are two or three stages, all nodes are on the main path or lead into it, and only gain cells are on it.
    """
    path, stages = main_path(g)
    if stages not in (2, 3):
        raise ValueError(f"{stages} stages")
    into = set(path) | {a for a, b, _ in g.edges if b in path}
    if into != set(g.labels):
        raise ValueError("a node neither is on the main path nor leads into it")
    if len(path) != stages + 2:
        raise ValueError("another cell than a gain cell is on the main path")
    order = [path[0], path[-1], *path[1:-1], *sorted(set(g.labels) - set(path))]
    return {n: k for k, n in enumerate(order)}, stages


def bypassed(g: Graph) -> bool:
    """Whether each inverting gain cell on a shortest path has an R or C beside it: one that a predecessor of the cell feeds and that shares a successor with it."""
    after = _after(g)
    before: dict = {n: [] for n in g.labels}
    for a, bs in after.items():
        for b in bs:
            before[b].append(a)
    a, b = (next(n for n, x in sorted(g.labels.items()) if x == label) for label in ("input", "output"))
    level, front = {a: 0}, [a]
    for n in front:
        for m in after[n]:
            if m not in level:
                level[m] = level[n] + 1
                front.append(m)
    if b not in level:
        return False
    on = {b}
    for n in sorted(level, key=level.get, reverse=True):
        if any(m in on and level.get(m) == level[n] + 1 for m in after[n]):
            on.add(n)
    cells = [n for n in on if g.labels[n] in ("-gm-", "+gm-")]
    return all(any(g.labels[c] in ("R", "C") and set(after[c]) & set(after[n]) for p in before[n] for c in after[p]) for n in cells)


# Fixed value: what stands for each predecessor's value in the text form.
VALUE = "11.11"


def as_text(g: Graph, value: str = VALUE) -> str:
    """A header with the numbers of nodes (twice) and stages, then for each node its code, number twice, predecessors and values."""
    new, stages = numbered(g)
    before: dict = {k: [] for k in new.values()}
    for a, b, _ in g.edges:
        before[new[b]].append(new[a])
    lines = [f"{len(new)} {len(new)} {stages}"]
    for n, k in sorted(new.items(), key=lambda x: x[1]):
        pred = sorted(before[k])
        fields = [CODES[g.labels[n]], k, k, len(pred), *pred]
        fields += ["1 8 0 1"] if k == 0 else ["1 9 0 1"] if k == 1 else ["-1", *[value] * len(pred), "-1"]
        lines.append(" ".join(map(str, fields)))
    return "\n".join(lines) + "\n"
