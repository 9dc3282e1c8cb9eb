import random

from pyspark.sql import functions as F

from weftgraph.operators import frontier
from weftgraph.operators.derivations import all_derivations
from weftgraph.operators.rewriting import Rule

EMB = frozenset({(x, "black", "black", 0, d, d) for x in ("a", "b") for d in ("in", "out")})
RULES = [Rule("black", ("a", "gray"), ((0, 1, "black"),)), Rule("gray", ("b", "gray"), ((0, 1, "black"),), EMB), Rule("gray", ("gray", "b"), ((0, 1, "black"),), EMB), Rule("gray", ("a",), (), EMB), Rule("gray", ("b",), (), EMB), Rule("gray", ("a", "b"), ((0, 1, "black"),), EMB), Rule("black", ("a",), ())]


def test_counts_equal_the_listed_sequences(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        n = rng.randrange(1, 6)
        nodes = [(i, rng.choice("abb")) for i in range(n)]
        edges = [(i, i + 1, "black") for i in range(n - 1)] + ([(0, n - 1, "black")] if n > 2 and rng.random() < 0.3 else [])
        rows.append((g, nodes, edges))
    df = spark.createDataFrame(rows, "graph_id long, nodes array<struct<node_id:long,label:string>>, edges array<struct<src:long,dst:long,label:string>>")
    want = {r.graph_id: r.n for r in all_derivations(df, RULES, {"gray", "black"}).select("graph_id", F.size("derivations").alias("n")).collect()}
    for ahead in (5000, 1):
        monkeypatch.setattr(frontier, "AHEAD", ahead)
        assert {r.graph_id: r.n_derivations for r in frontier.derivation_counts(df, RULES, {"gray", "black"}).collect()} == want
    assert max(want.values()) > 1 and min(want.values()) == 0
