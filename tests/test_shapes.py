"""Graphs of one shape are worked on once, and each gets its own rows."""

import pytest

from weftgraph.operators import ego, shapes, traversal
from weftgraph.sources.views import Graphs


def collection(spark, many):
    """Three-node paths a>b>c with other ids in each graph, and a lone node."""
    nodes = [(k, 10 * k + i, x) for k in range(many) for i, x in ((1, "a"), (5, "b"), (7, "c"))] + [(many, 3, "a")]
    edges = [(k, 10 * k + i, 10 * k + j, "x") for k in range(many) for i, j in ((1, 5), (5, 7))]
    return Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame(edges, "graph_id long, src long, dst long, label string"))


def test_shapes_are_few_and_rows_have_own_ids(spark):
    s = shapes.shaped(collection(spark, 20))
    assert s.firsts.count() == 2 and sorted(r.often for r in s.firsts.collect()) == [1, 20]
    back = s.spread(s.g.nodes).select("graph_id", shapes.named("node_id").alias("n"), "label").collect()
    assert sorted((r.graph_id, r.n, r.label) for r in back) == sorted([(k, 10 * k + i, x) for k in range(20) for i, x in ((1, "a"), (5, "b"), (7, "c"))] + [(20, 3, "a")])


@pytest.mark.parametrize("few", [50_000, 0])
def test_neighbourhoods_are_hashed_once_for_a_shape(spark, monkeypatch, few):
    monkeypatch.setattr(shapes, "FEW", few)
    sizes, real = [], ego.hashes
    monkeypatch.setattr(ego, "hashes", lambda g, *a: sizes.append(g.nodes.count()) or real(g, *a))
    got = {(r.graph_id, r.node_id): r.label for r in ego.relabelled(collection(spark, 20), 1).nodes.collect()}
    assert got == {(k, 10 * k + i): x for k in range(20) for i, x in ((1, "0"), (5, "1"), (7, "0"))} | {(20, 3): "0"}
    assert sizes == [4]


def test_equal_graphs_are_given_to_the_function_once(spark):
    nodes = [(k, i, x) for k in range(30) for i, x in ((1, "a"), (2, None))] + [(99, 4, "z")]
    g = Graphs(spark.createDataFrame(nodes, "graph_id long, node_id long, label string"), spark.createDataFrame([(k, 1, 2, "x") for k in range(30)], "graph_id long, src long, dst long, label string"))
    calls = spark.sparkContext.accumulator(0)

    def fn(labels, edges):
        calls.add(1)
        yield from ((n, x, len(edges)) for n, x in labels.items())

    got = traversal.per_graph(g, fn, "node_id long, label string, m long").collect()
    assert sorted(map(tuple, got)) == sorted([(k, i, x, 1) for k in range(30) for i, x in ((1, "a"), (2, "#"))] + [(99, 4, "z", 0)])
    assert calls.value == 2
