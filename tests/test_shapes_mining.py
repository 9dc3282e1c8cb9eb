"""Motifs are grown in one graph of each shape and counted in all."""

from weftgraph.operators import mining
from tests.test_shapes import collection


def test_motifs_grow_in_one_graph_of_a_shape(spark, monkeypatch):
    sizes, real = [], mining._first
    monkeypatch.setattr(mining, "_first", lambda g: sizes.append(g.nodes.count()) or real(g))
    rows = {r.code: r for r in mining.mine(collection(spark, 20), most=3, least=2).collect()}
    assert sizes == [4] and len(rows) == 3
    whole = rows["a;b;c/0>1:x;1>2:x"]
    assert (whole.n_matches, whole.n_graphs, whole.gain, whole.graph_id, whole.nodes) == (20, 20, 20 * 4 - 5, 0, [1, 5, 7])
