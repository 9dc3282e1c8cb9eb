"""Grammars of hyperedge replacement are learnt from different graphs only."""

from tests.test_shapes import collection
from weftgraph.operators import hrg
from weftgraph.plans import hrg_queries
from weftgraph.sources.views import Graphs


def test_kinds_teach_the_rules_of_all_graphs(spark):
    g = collection(spark, 20)
    same = Graphs(g.nodes.withColumn("node_id", g.nodes.node_id - 10 * g.nodes.graph_id), g.edges.selectExpr("graph_id", "src - 10 * graph_id AS src", "dst - 10 * graph_id AS dst", "label"))
    few = hrg.kinds(same)
    assert sorted((r.graph_id, r.often) for r in few.collect()) == [(0, 20), (20, 1)]
    assert sorted(map(tuple, hrg.learn(few).collect())) == sorted(map(tuple, hrg.learn(hrg.hypergraphs(same)).collect()))


def test_queries_ask_for_kinds(spark, monkeypatch):
    monkeypatch.setattr(hrg, "hypergraphs", None)
    assert hrg_queries.hrg_chain_rules(spark, "/root/testdata/sf0.001").count() == 2
