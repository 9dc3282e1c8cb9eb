"""Learnt rules derive their inputs again."""

import random
from itertools import product

from tests.test_operators import graphs
from weftgraph.operators.rewriting import Graph, apply
from weftgraph.plans import embedded
from weftgraph.sources import views


def some_graph(rng, n):
    labels = {k: rng.choice("abc") for k in range(n)}
    edges = {(a, b, rng.choice(["x", "black"])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35 or b == a + 1}
    return Graph(labels, edges)


def test_a_contraction_is_undone_by_its_rule_alone():
    """Every way to contract a pair, against all directions of all neighbours tried one by one."""
    rng = random.Random(1)
    tried = 0
    for _ in range(60):
        g = some_graph(rng, rng.randrange(3, 6))
        for (labels, edges), nodes in embedded.matches(g, "gray"):
            near = sorted({y for e in g.edges for y in e[:2] if set(e[:2]) & set(nodes)} - set(nodes))
            ways = {tuple(sorted(new.items())): (ins, outs) for new, ins, outs in embedded.realised(g, nodes, ["black", "x"], "black")}
            for dirs in product(("in", "out"), repeat=len(near)):
                new = dict(zip(near, dirs, strict=True))
                small = embedded.contracted(g, nodes, new, "gray", "black")
                key = tuple(sorted(new.items()))
                if key in ways:
                    tried += 1
                    rule = embedded.Rule("gray", labels, edges, ways[key][0])
                    assert embedded.admits(rule, *ways[key]) and apply(small, min(nodes), rule)[0].form() == g.form()
                else:  # neighbours of one label and direction that are joined differently, or of one kind in both directions
                    kinds = {}
                    for y in near:
                        kind = frozenset((nodes.index(a), "out", x) if b == y else (nodes.index(b), "in", x) for a, b, x in g.edges if y in (a, b) and set((a, b)) & set(nodes))
                        kinds.setdefault((g.labels[y], kind), set()).add(new[y])
                    mixed = any(len(d) > 1 for d in kinds.values())
                    assert mixed or len({(mu, d) for (mu, _), ds in kinds.items() for d in ds}) < len(kinds)
    assert tried > 100


def test_all_inputs_come_back(spark):
    rng = random.Random(2)
    made = {}
    for k in range(5):
        g = some_graph(rng, k + 1)
        made[k] = (g.labels, sorted(g.edges))
    made[5] = made[3]
    rows = embedded.round_trip(graphs(spark, made)).collect()
    assert len(rows) == 6 and all(r.same and r.n_nodes == len(made[r.graph_id][0]) and r.n_edges == len(made[r.graph_id][1]) for r in rows)


def test_rules_have_bounds_and_compress_until_none_fits(spark):
    learnt, left = embedded.learn(views.conversation_graphs(spark, "/root/testdata/sf0.001"))
    assert learnt and all(x.rule.embedding <= x.upper for x in learnt)
    for r in left.collect():
        g, steps = embedded._load(r.state)
        assert not embedded.matches(g, "gray") or not any(list(embedded.realised(g, n, ["black"], "black")) for _, n in embedded.matches(g, "gray"))
        assert embedded.compressed(g, [x.rule for x in learnt], "gray", ["black"], "black") == (g, [])
        assert sum(x == "gray" for x in g.labels.values()) <= 1
    starts = embedded.start_rules(left)
    assert starts.select("left_form").distinct().count() < starts.count()


def test_a_clique_takes_no_realisation_that_another_forbids():
    i, j = ("a", "black", "x", 0, "in", "in"), ("a", "black", "x", 1, "in", "in")
    needs, bans = embedded.clique([(5, frozenset([i]), frozenset([j])), (4, frozenset([j]), frozenset()), (3, frozenset([i]), frozenset())])
    assert needs == {i} and bans == {j}
