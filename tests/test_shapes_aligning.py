"""Graphs of one shape are laid on the first of their form once."""

from tests.test_shapes import collection
from weftgraph.operators import traversal
from weftgraph.plans import change_queries, queries


def test_graphs_of_one_shape_are_laid_once(spark, monkeypatch):
    asked, real = [], traversal.canonical_places
    monkeypatch.setattr(traversal, "canonical_places", lambda g: asked.append(g.nodes.select("graph_id").distinct().count()) or real(g))
    monkeypatch.setattr(change_queries.views, "order_graphs", lambda *_: collection(spark, 20))
    got = queries.QUERIES["aligned_edges"](spark, "").orderBy("graph_id").collect()
    assert [tuple(r) for r in got] == [(k, 2, 2) for k in range(20)] + [(20, 0, 0)] and asked == [2]
