import itertools
import json
import math
import random

import pytest

from weftgraph.operators import components, hypergraphs, instructions, masks, matching, metrics, primitives, rewriting, search, tournaments, traversal
from weftgraph.plans import fixtures, learning
from weftgraph.sources.views import Graphs


def graphs(spark, made):
    """made: {graph_id: (labels by node, [(src, dst, label)])}"""
    nodes = [(g, n, x) for g, (labels, _) in made.items() for n, x in labels.items()]
    edges = [(g, *e) for g, (_, es) in made.items() for e in es]
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id int, label string"), spark.createDataFrame(edges, "graph_id long, src int, dst int, label string"))


def random_graphs(seed, n=25, size=7):
    rng = random.Random(seed)
    out = {}
    for g in range(n):
        labels = {k: rng.choice(["a", "b", None]) for k in range(rng.randrange(1, size))}
        out[g] = (labels, [(a, b, rng.choice(["x", "y"])) for a in labels for b in labels if a != b and rng.random() < 0.35])
    return out


@pytest.mark.parametrize("case", membership_ids := [f"{name}:{k}" for name, _, tests in fixtures.membership_cases() for k in range(len(tests))])
def test_membership(case):
    name, k = case.split(":")
    g, (h, member) = next((g, tests[int(k)]) for n, g, tests in fixtures.membership_cases() if n == name)
    assert hypergraphs.derives(json.loads(g), json.loads(h)) == member


def test_membership_ends_with_rules_that_change_nothing():
    loop = fixtures.grammar("S", {"S": 0, "T": 0, "a": None}, [("S", hypergraphs.hypergraph(0, 0, [([], "T")])), ("T", hypergraphs.hypergraph(0, 0, [([], "S")])), ("T", hypergraphs.hypergraph(0, 0, [([], "a")]))])
    assert hypergraphs.derives(loop, hypergraphs.hypergraph(0, 0, [([], "a")]))
    assert not hypergraphs.derives(loop, hypergraphs.hypergraph(0, 0, [([], "a"), ([], "a")]))


@pytest.mark.parametrize("induced", [True, False])
def test_matching_equals_brute_force(spark, induced):
    made = random_graphs(1)
    g = graphs(spark, made)
    patterns = [
        matching.Pattern((None, None, None), ((0, 1, None), (1, 2, None))),
        matching.Pattern(("a", None, "b"), ((0, 1, "x"), (2, 1, None))),
        matching.Pattern((None, None), ((0, 1, None), (1, 0, None))),
        matching.Pattern(("a", "b"), ()),
        matching.Pattern(("#", None, None, None), ((0, 1, None), (1, 2, None), (3, 0, "y"), (0, 2, None))),
    ]
    for p in patterns:
        want = []
        for gid, (labels, edges) in made.items():
            e = {(a, b): x for a, b, x in edges}
            for m in itertools.permutations(labels, len(p.labels)):
                ok = all(x is None or (labels[n] or "#") == x for n, x in zip(m, p.labels, strict=True))
                asked = {(m[a], m[b]): x for a, b, x in p.edges}
                ok = ok and all(k in e and x in (None, e[k]) for k, x in asked.items())
                if induced:
                    ok = ok and all(k in asked for k in e if k[0] in m and k[1] in m)
                if ok:
                    want.append((gid, *m))
        for small in (True, False):
            rows = matching.match(g, p, induced, small).collect()
            assert sorted(tuple(r)[: 1 + len(p.labels)] for r in rows) == sorted(want), (p, small)
            assert all(r[f"{c}_label"] == (made[r.graph_id][0][r[c]] or "#") for r in rows for c in p.columns)


def test_canonical_forms_tell_graphs_apart():
    rng = random.Random(3)
    for labels, edges in random_graphs(2, 40, 6).values():
        labels = {n: x or "#" for n, x in labels.items()}
        names = list(labels)
        moved = dict(zip(names, rng.sample(range(100), len(names)), strict=True))
        other = {moved[n]: x for n, x in labels.items()}, sorted((moved[a], moved[b], x) for a, b, x in edges)
        assert traversal.canonical(labels, edges) == traversal.canonical(*other)
        if edges:
            a, b, x = edges[0]
            assert traversal.canonical(labels, edges) != traversal.canonical(labels, [(a, b, "z"), *edges[1:]])
    ring = lambda k, at: [(at + i, at + (i + 1) % k, "") for i in range(k)]
    assert traversal.canonical(dict.fromkeys(range(6), "a"), ring(6, 0)) != traversal.canonical(dict.fromkeys(range(6), "a"), ring(3, 0) + ring(3, 3))


def test_closure_and_levels_equal_brute_force(spark):
    made = {g: (n, [(a, b, x) for a, b, x in e if a < b]) for g, (n, e) in random_graphs(5).items()} | {99: ({0: "a", 1: "a", 2: "b"}, [(0, 1, "x"), (1, 0, "x"), (1, 2, "x")])}
    g = graphs(spark, made)
    reach = {}
    for gid, (labels, edges) in made.items():
        r = {(a, b) for a, b, _ in edges}
        while True:
            more = {(a, d) for a, b in r for c, d in r if b == c} - r
            if not more:
                break
            r |= more
        reach |= {(gid, *p): True for p in r}
    closed = traversal.closure(g.edges)
    assert {tuple(r) for r in closed.collect()} == set(reach)
    dag = {r.graph_id: r.is_dag for r in traversal.acyclic(closed, g.nodes).collect()}
    assert not dag.pop(99) and all(dag.values())
    rows = {(r.graph_id, r.node_id): r for r in traversal.levels(g).collect()}
    assert rows[99, 0].level is None and rows[99, 2].level is None and rows[99, 2].rank_back == 0
    for gid, (labels, edges) in made.items():
        if gid != 99:
            for n in sorted(labels):
                before = [rows[gid, a] for a, b, _ in edges if b == n]
                assert rows[gid, n].level == (1 + max(x.level for x in before) if before else 0)
                assert rows[gid, n].depth == (1 + min(x.depth for x in before) if before else 0)


def test_derivation_of_a_row_of_houses(spark):
    rules = fixtures.house_rules()
    g = rewriting.derive(rules, [0, 1, 1, 2], fixtures.NONTERMINALS)
    assert len(g.labels) == 15 and set(g.labels.values()) == {"cyan"} and rewriting.connected(g)
    with pytest.raises(ValueError):
        rewriting.derive(rules, [1], fixtures.NONTERMINALS)
    seq = spark.createDataFrame([(1, [0, 1, 2]), (2, [1]), (3, [0, 1, 2])], "seq_id long, rules array<int>")
    out = {r.seq_id: r for r in rewriting.derive_all(seq, rules, fixtures.NONTERMINALS).collect()}
    assert out[1].form == out[3].form and out[1].n_nodes == 11 and out[2].problem


def test_rule_as_joins_equals_rule_in_a_task(spark):
    rule = rewriting.Rule("a", ("a", "b", "c"), ((0, 1, "x"), (2, 1, "y")), frozenset({("a", "x", "q", 0, "out", "out"), ("b", "x", "r", 1, "in", "out"), ("b", "y", "s", 2, "out", "in"), ("a", "y", "t", 1, "in", "in")}))
    made = {g: ({n: x or "a" for n, x in labels.items()}, edges) for g, (labels, edges) in random_graphs(7).items()}
    out = rewriting.apply_once(graphs(spark, made), spark.createDataFrame([(g, 0) for g in made], "graph_id long, node_id int"), rule)
    edges, nodes = {}, {}
    for r in out.edges.collect():
        edges.setdefault(r.graph_id, set()).add((r.src, r.dst, r.label))
    for r in out.nodes.collect():
        nodes.setdefault(r.graph_id, {})[r.node_id] = r.label
    for g, (labels, es) in made.items():
        want, _, _ = rewriting.apply(rewriting.Graph(labels, set(es)), 0, rule)
        assert nodes[g] == want.labels and edges.get(g, set()) == want.edges


def test_contraction_and_learning(spark):
    made = {1: ({1: "a", 2: "b", 3: "a"}, [(1, 2, "x"), (2, 3, "y"), (1, 3, "y")]), 2: ({1: "a", 2: "b"}, [(1, 2, "x")]), 3: ({1: "c"}, [])}
    g = graphs(spark, made)
    rules, anno, left = learning.learn(g)
    assert [(r.src_label, r.dst_label, r.n_graphs) for r in rules.orderBy("rule_id").collect()] == [("a", "b", 2), ("gray", "a", 1)]
    assert anno.count() == 3 and sorted((r.graph_id, r.label) for r in left.nodes.collect()) == [(1, "gray"), (2, "gray"), (3, "c")]
    assert left.edges.count() == 0


def test_realisations_of_a_match(spark):
    g = graphs(spark, {1: ({1: "A", 2: "N", 3: "R"}, [(1, 2, "black"), (2, 3, "black")])})
    m = spark.createDataFrame([(1, 7, [1, 2])], "graph_id long, ism_id int, nodes array<int>")
    rows = {r.dir_id: r for r in instructions.realisations(g, m, 2).collect()}
    assert rows[0].ins == ["R|black|black|1|out|out"] and rows[1].ins == ["R|black|black|1|in|out"]
    assert rows[0].outs == ["R|black|black|0|out|in", "R|black|black|0|out|out", "R|black|black|1|out|in"]
    ok = instructions.admitted(instructions.realisations(g, m, 2), ["R|black|black|1|out|out", "X"])
    assert [r.dir_id for r in ok.collect()] == [0]
    assert len(instructions.upper(["R"], "black", 2, set(rows[0].outs))) == 8 - 3


def test_searches():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(1, 9)
        near = {k: set() for k in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                near[a].add(b)
                near[b].add(a)
        is_clique = lambda c: all(b in near[a] for a, b in itertools.combinations(c, 2))  # noqa: E731, B023
        every = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if is_clique(c)]
        assert search.maximal_cliques(near) == sorted(c for c in every if not any(set(c) < set(d) for d in every))
        assert is_clique(search.best_clique(near)) and len(search.best_clique(near)) >= max(map(len, every)) - 1
        assert search.chordal(search.complete(near, [list(range(n))]))
        sets = [rng.sample(range(6), rng.randrange(1, 4)) for _ in range(5)]
        least = next(c for k in range(7) for c in itertools.combinations(range(6), k) if all(set(c) & set(s) for s in sets))
        assert len(search.hitting_set(sets)) == len(least)
    assert search.spanning_tree("abc", [("a", "b", 1), ("b", "c", 3), ("a", "c", 2)]) == [("b", "c", 3), ("a", "c", 2)]
    assert search.disambiguate([[1, 2], [1, 3], [1, 4]], {2, 3, 4}) == ([1, 2], [3, 4])
    assert search.disambiguate([[1, 2], [1, 2, 3]], {1, 2}) is None


def test_scores(spark):
    p = tournaments.strengths([(0, 1, 4.5, 0.5), (1, 2, 4.5, 0.5), (0, 2, 4.5, 0.5)], 3)
    assert p[0] > p[1] > p[2]
    rng = random.Random(3)
    games = [(7, *rng.sample(range(6), 2), rng.choice([0.2, 0.5, 0.8])) for _ in range(40)]
    plain = [1.0] * 6  # the rule game by game
    for _ in range(100):
        old = plain[:]
        for k in range(6):
            mine = [(s, j) if i == k else (1 - s, i) for _, i, j, s in games if k in (i, j)]
            if mine:
                plain[k] = sum(s for s, _ in mine) / sum(s + (1 - s) * plain[o] / plain[k] for s, o in mine)
        if max(abs(a - b) for a, b in zip(plain, old, strict=True)) < 1e-6:
            break
    got = {r.player: r.strength for r in tournaments.bradley_terry(spark.createDataFrame(games, "item long, i long, j long, s double")).collect()}
    assert all(math.isclose(got[k], plain[k], rel_tol=1e-9) for k in got) and len(got) == len({x for g in games for x in g[1:3]})
    found = spark.createDataFrame([("x", True), ("x", True), ("y", True), ("z", False), ("k", True)], "form string, valid boolean")
    e = metrics.evaluate(found, spark.createDataFrame([("k",)], "form string")).first()
    assert (e.n, e.valid, e.novel, e.unique) == (5, 0.8, 0.6, 0.4)
    assert [r.is_unique for r in metrics.uniqueness(found).orderBy("form").collect()] == [True, False, False, True, True]


def test_masks(spark):
    rules = fixtures.house_rules()
    out = masks.masks(spark.createDataFrame([(1, []), (2, [0]), (3, [1]), (4, [0, 2])], "id long, rules array<int>"), rules, fixtures.NONTERMINALS)
    got = {r.id: r["mask"] for r in out.collect()}
    assert got[1] == [True, False, False] and got[3] == [] and got[4] == [False] * 3
    chain = rewriting.Graph({0: "in", 1: "m", 2: "out"}, {(0, 1, "x"), (1, 2, "x")})
    assert masks.acyclic(chain) and masks.hamiltonian(chain) and masks.on_the_way(chain, "in", "out")
    assert not masks.hamiltonian(rewriting.Graph(chain.labels, {(0, 1, "x"), (0, 2, "x")}))


def test_partition_and_components(spark):
    g = graphs(spark, {1: (dict.fromkeys(range(1, 7), "a"), [(k, k + 1, "x") for k in range(1, 6)])})
    blocks, edges = primitives.partition(g, 3)
    assert sorted((r.block, r.node_id, r.halo) for r in blocks.collect()) == sorted([(0, k, False) for k in (1, 2, 3)] + [(1, k, False) for k in (4, 5, 6)] + [(0, 4, True), (1, 3, True)])
    assert edges.count() == 6
    assert components.components(spark.createDataFrame([(3, 4), (4, 9), (7, 8)], "a long, b long")).count() == 5


def test_fits_and_orders():
    g = rewriting.Graph({0: "input", 1: "gray"}, {(0, 1, "black")})
    ok = rewriting.Rule("gray", ("m", "output"), ((0, 1, "black"),), frozenset({("input", "black", "black", 0, "in", "in")}))
    bad = rewriting.Rule("gray", ("m", "input"), ((0, 1, "black"),))
    assert masks.fits_amplifier(g, 1, ok) and not masks.fits_amplifier(g, 1, bad)
    assert masks.fits_chain(g, 1, ok) and not masks.fits_chain(g, 1, rewriting.Rule("gray", ("m", "n"), ()))
    assert masks.fits_network(g, 1, ok) and not masks.fits_network(g, 1, rewriting.Rule("gray", ("input",), ()))
    assert masks.post_order({1: [2, 3], 3: [4]}, 1) == [2, 4, 3, 1]
    assert masks.breadth_first(rewriting.Graph(dict.fromkeys(range(4), "a"), {(2, 0, ""), (0, 1, ""), (1, 3, "")}), 0) == [0, 1, 2, 3]
