import random

import pytest

from weftgraph.operators import circuits, paths
from weftgraph.operators.rewriting import Graph
from weftgraph.sources.views import Graphs

CELLS = ["R", "C", "+gm+", "-gm+", "+gm-", "-gm-"]


def made(seed):
    rng, out = random.Random(seed), {}
    for k in range(60):
        n = rng.randrange(3, 8)
        labels = {i: rng.choice(CELLS) for i in range(n)} | {0: "input", n - 1: "output"}
        chance = rng.choice([0.2, 0.4])
        edges = {(a, b, "x") for a in range(n) for b in range(n) if a != b and rng.random() < chance}
        if k % 3 == 0:
            edges = {e for e in edges if e[0] < e[1]}
        if k % 2:
            labels = {i: "+gm-" if 0 < i < 3 and i < n - 1 else x for i, x in labels.items()}
            edges |= {(a, b, "x") for a, b in ((0, 1), (1, 2), (2, n - 1)) if a < b}
        out[k] = Graph(labels, edges)
    out[97] = Graph({4: "input"}, set())
    out[98] = Graph({0: "input", 1: "+gm-", 2: "output"}, {(0, 1, "x")})
    return out


def tables(spark, graphs):
    nodes = [(k, i, x) for k, g in graphs.items() for i, x in g.labels.items()]
    edges = [(k, a, b, x) for k, g in graphs.items() for a, b, x in g.edges] * 2
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, src long, dst long, label string"))


@pytest.fixture(scope="module")
def some(spark):
    graphs = made(5)
    return graphs, tables(spark, graphs)


def test_paths_equal_a_walk_of_each_graph(some):
    graphs, g = some
    has = {k: x for k, x in graphs.items() if k != 97}
    every = sorted((k, tuple(p)) for k, x in has.items() for p in circuits.simple_paths(x, 0, max(x.labels)))
    assert sorted((r.graph_id, tuple(r.path)) for r in paths.simple_paths(g, "input", "output").collect()) == every
    best = {r.graph_id: (r.path, r.stages) for r in paths.main_paths(g).collect()}
    assert best == {k: circuits.main_path(x) for k, x in has.items()} | {97: ([], 0)}


def test_numbers_texts_and_bypasses_equal_those_of_each_graph(some):
    graphs, g = some
    got, lines = {}, {r.graph_id: r for r in paths.texts(g).collect()}
    for r in paths.numbered(g).collect():
        got.setdefault(r.graph_id, {})[r.node_id] = (r.number, r.stages, r.problem)
    good = 0
    for k, x in graphs.items():
        if k == 97:
            assert got[k] == {4: (None, 0, "0 stages")}
            continue
        try:
            new, stages = circuits.numbered(x)
            assert got[k] == {n: (i, stages, None) for n, i in new.items()}
            assert lines[k].text == circuits.as_text(x) and lines[k].problem is None
            good += 1
        except ValueError as e:
            assert {v[0] for v in got[k].values()} == {None} and {v[2] for v in got[k].values()} == {str(e)}
            assert lines[k].text is None and lines[k].problem == str(e)
    beside = {r.graph_id: r.bypassed for r in paths.bypassed(g).collect()}
    assert beside == {k: circuits.bypassed(x) for k, x in graphs.items() if k != 97} | {97: False}
    assert good > 5 and 5 < sum(beside.values()) < 55


def test_no_graphs_give_no_rows(spark):
    g = tables(spark, {0: Graph({0: "input"}, {(0, 0, "x")})})
    none = Graphs(g.nodes.where("false"), g.edges.where("false"))
    for f in (paths.main_paths, paths.numbered, paths.bypassed, paths.texts, lambda x: paths.simple_paths(x, "input", "output")):
        assert f(none).count() == 0
    assert paths.main_paths(g).first().path == []


def test_equal_circuits_are_walked_once(spark, monkeypatch):
    """Circuits with other ids and other cells of the same kind share a shape, and each has its own text."""
    one = {i: x for i, x in enumerate(["input", "+gm-", "-gm+", "output"])}
    graphs = {k: Graph({i + k: ("-gm-" if x == "+gm-" and k % 2 else x) for i, x in one.items()}, {(i + k, i + k + 1, "x") for i in range(3)}) for k in range(40)}
    g, seen, real = tables(spark, graphs), [], paths._grown
    monkeypatch.setattr(paths, "_grown", lambda g, *a: seen.append(g.nodes.count()) or real(g, *a))
    assert {r.graph_id: r.text for r in paths.texts(g).collect()} == {k: circuits.as_text(x) for k, x in graphs.items()}
    assert {r.graph_id: r.path for r in paths.main_paths(g).collect()} == {k: [k, k + 1, k + 2, k + 3] for k in graphs}
    assert {(r.graph_id, r.n_paths, r.longest) for r in paths.path_counts(g, "input", "output").collect()} == {(k, 1, 4) for k in graphs}
    assert seen == [4, 4, 4]
