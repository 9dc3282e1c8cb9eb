"""Equal inputs of a step are worked on once, and all get its rows."""

from pyspark.sql import functions as F

from tests.test_shapes import collection
from weftgraph.operators import instructions, masks
from weftgraph.operators.rewriting import Rule


def test_realisations_are_made_once_for_each_set_of_neighbours(spark, monkeypatch):
    g = collection(spark, 20)
    isms = g.edges.select("graph_id", F.col("src").alias("ism_id"), F.array("src", "dst").alias("nodes"))
    asked, real = [], instructions._realised
    monkeypatch.setattr(instructions, "_realised", lambda around, isms, *a: asked.append(isms.count()) or real(around, isms, *a))
    got = {(r.graph_id, r.ism_id, r.dir_id): (r.ins, r.outs) for r in instructions.realisations(g, isms, 2).collect()}
    assert asked == [2]
    alone = {k: v for k, v in got.items() if k[0] == 0}
    assert len(alone) == 4 and got == {(k, i + 10 * k, d): v for k in range(20) for (_, i, d), v in alone.items()}


def test_masks_are_made_once_for_each_sequence(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    real = masks.legal
    monkeypatch.setattr(masks, "legal", lambda *a: calls.add(1) or real(*a))
    rules = [Rule("black", ("a",), (), frozenset())]
    states = spark.createDataFrame([(k, []) for k in range(30)], "id long, rules array<int>")
    assert sorted(map(tuple, masks.masks(states, rules, {"black"}).collect())) == [(k, [True]) for k in range(30)]
    assert calls.value == 1
