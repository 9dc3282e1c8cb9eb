"""Each sequence of rules is derived once."""

from weftgraph.operators import rewriting
from weftgraph.operators.rewriting import Rule


def test_each_sequence_is_derived_once(spark, monkeypatch):
    calls, real = spark.sparkContext.accumulator(0), rewriting.derive
    monkeypatch.setattr(rewriting, "derive", lambda *a: calls.add(1) or real(*a))
    seq = spark.createDataFrame([(k, [k % 2]) for k in range(30)] + [(30, None)], "seq_id long, rules array<int>")
    got = {r.seq_id: (r.n_nodes, r.problem is None) for r in rewriting.derive_all(seq, [Rule("black", ("a",), ()), Rule("gray", ("b",), ())], {"black", "gray"}).collect()}
    assert got == {k: (1, True) if k % 2 == 0 else (None, False) for k in range(30)} | {30: (None, False)}
    assert calls.value == 2
