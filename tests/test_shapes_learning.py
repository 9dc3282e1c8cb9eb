"""Grammars are learnt from each shape once."""

from tests.test_shapes import collection
from weftgraph.plans import learning


def test_grammars_are_learnt_from_each_shape_once(spark, monkeypatch):
    sizes, real = [], learning.compress
    monkeypatch.setattr(learning, "compress", lambda state, *a: sizes.append(state.count()) or real(state, *a))
    rules, anno, left = learning.learn(collection(spark, 20))
    assert set(sizes) == {2}
    assert [tuple(r) for r in rules.orderBy("rule_id").collect()] == [(0, "a", "b", 20), (1, "gray", "c", 20)]
    assert sorted((r.graph_id, r.seq, r.rule_id, r.nodes) for r in anno.collect()) == sorted(x for k in range(20) for x in ((k, 0, 0, [10 * k + 1, 10 * k + 5]), (k, 1, 1, [10 * k + 1, 10 * k + 7])))
    assert sorted((r.graph_id, r.node_id, r.label) for r in left.nodes.collect()) == [(k, 10 * k + 1, "gray") for k in range(20)] + [(20, 3, "a")]
    assert left.edges.count() == 0
    starts = learning.grammar(collection(spark, 20)).where("form IS NOT NULL").orderBy("rule_id").collect()
    assert [(r.rule_id, r.n_graphs) for r in starts] == [(2, 20), (3, 1)]
