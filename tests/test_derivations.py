import pytest

from weftgraph.operators import circuits, derivations, undirected
from weftgraph.operators.rewriting import Graph, Rule, derive, generate, sample
from weftgraph.plans import fixtures

NT = fixtures.NONTERMINALS


def test_house_rows_have_the_derivation_they_came_from():
    rules = fixtures.house_rules()
    for n in range(3):
        seq = [0, *[1] * n, 2]
        g = derive(rules, seq, NT)
        found = derivations.derivations(g, rules, NT)
        assert seq in found and all(derivations.round_trip(g, s, rules, NT) for s in found)


def test_ambiguous_rules_are_found_and_resolved(spark):
    emb = frozenset({("a", "black", "black", 0, "in", "in")})
    rules = [Rule("black", ("a", "gray"), ((0, 1, "black"),)), Rule("gray", ("a", "gray"), ((0, 1, "black"),), emb), Rule("gray", ("a",), (), emb), Rule("gray", ("a", "a"), ((0, 1, "black"),), emb)]
    made = [(n, derive(rules, [0, *[1] * n, 2], NT)) for n in range(4)]
    rows = [(n, [(k, x) for k, x in g.labels.items()], sorted(g.edges)) for n, g in made]
    df = spark.createDataFrame(rows, "graph_id long, nodes array<struct<node_id:int,label:string>>, edges array<struct<src:int,dst:int,label:string>>")
    ways = {r.graph_id: r.derivations for r in derivations.all_derivations(df, rules, NT).collect()}
    assert ways[0] == [[0, 2]] and sorted(ways[2]) == [[0, 1, 1, 2], [0, 1, 3]]
    gone, settled, lost = derivations.resolve([(n, len(g.labels), ways[n]) for n, g in made])
    assert gone == {3} and not lost and settled[3] == [0, 1, 1, 1, 2]


def test_orders_and_variants():
    assert derivations.orders({1: [2, 3], 3: [4]}, 1) == [[1, 2, 3, 4], [1, 3, 4, 2]]
    rules = fixtures.house_rules()
    assert len(derivations.variants(rules, [[0, 2], [0, 2], [0, 1, 2], [2]], NT)) == 2
    steps = derivations.applied([0, 1, 2], rules, NT)
    assert [len(s[1]) for s in steps] == [4, 5, 4] and all(s[2] for s in steps[1:])


def test_generation_is_seeded_and_distinct(spark):
    rules = fixtures.house_rules()
    a, b = (generate(spark, rules, NT, 50).orderBy("form").collect() for _ in range(2))
    assert a == b and len({r.form for r in a}) == len(a) and sum(r.n_found for r in a) <= 50
    assert sample([Rule("black", ("black", "a"), ((0, 1, "black"),))], NT, 1) is None


def circuit():
    labels = {5: "input", 6: "+gm-", 7: "+gm+", 8: "output", 9: "C", 10: "R"}
    return Graph(labels, {(5, 6, ""), (6, 7, ""), (7, 8, ""), (5, 9, ""), (9, 7, ""), (10, 7, "")})


def test_circuits():
    g = circuit()
    assert circuits.main_path(g) == ([5, 6, 7, 8], 2) and circuits.bypassed(g)
    new, stages = circuits.numbered(g)
    assert stages == 2 and new[5] == 0 and new[8] == 1 and new[6] == 2
    assert circuits.as_text(g).splitlines()[:3] == ["6 6 2", "0 0 0 0 1 8 0 1", "1 1 1 1 3 1 9 0 1"]
    assert not circuits.bypassed(Graph(g.labels, g.edges - {(9, 7, "")}))
    with pytest.raises(ValueError):
        circuits.numbered(Graph(g.labels | {11: "R"}, g.edges))
    assert set(circuits.trimmed(g).labels) == {5, 6, 7, 8, 9}
    assert circuits.trimmed(g, loose=False).edges <= circuits.trimmed(g).edges


@pytest.mark.parametrize("by_label", [True, False])
def test_undirected_contraction_is_undone_by_the_rule(by_label):
    g = undirected.Plain({1: "a", 2: "b", 3: "c", 4: "d"}, {(1, 2), (2, 3), (3, 4), (1, 4)})
    rule = undirected.extract(g, [[1, 2]], "gray", by_label)
    small, done = undirected.contract_all(g, [[1, 2], [2, 3], [3, 4]], "gray", {"gray"})
    assert done == [0] and len(small.labels) == 3
    assert undirected.apply(small, 1, rule).form() == g.form()
    assert not undirected.compatible(({("a", "b")}, set()), (set(), {("a", "b")}))
    start = undirected.PlainRule("black", ("gray", "c", "d"), ((0, 1), (0, 2), (1, 2)))
    assert undirected.sample([start, rule], {"gray", "black"}, 1).form() == g.form()
