"""Queries cover their whole tables: no id prefix, no fixed length, no fixed number of rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import graphs
from weftgraph.functions import tokens
from weftgraph.operators import hypergraphs, instructions, metrics
from weftgraph.plans import learning
from weftgraph.plans.queries import QUERIES
from weftgraph.sources import views

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [7, 512])
def test_all_pairs_of_a_group_have_their_distance(spark, tmp_path, block):
    rng = random.Random(2)
    rows = [(k, k % 3 if k % 11 else 0, [rng.random() for _ in range(4)]) for k in range(450, 650)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    read = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    held = [(r.vec_id, r.label, list(r.embedding)) for r in read.collect()]
    for i, a, x in held:
        for j, b, y in held:
            if a == b and i < j:
                n, s = want.get(a, (0, 0.0))
                want[a] = (n + 1, s + math.dist(x, y))
    got = metrics.mean_distance(read, "label", "vec_id", "embedding", block).collect()
    assert {r.label: r.n_pairs for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(math.isclose(r.mean_distance, want[r.label][1] / want[r.label][0], rel_tol=1e-12) for r in got)
    assert {(r.label, r.n_pairs) for r in QUERIES["pairwise_distance"](spark, str(tmp_path)).collect()} == {(k, n) for k, (n, _) in want.items()}


def test_rules_of_all_parts_fit_all_orders(spark):
    got = QUERIES["rule_choices"](spark, DIR)
    orders, part = (views.table(spark, DIR, t) for t in ("orders", "part"))
    fit = part.select((F.col("p_partkey") % 7).alias("arity"), F.when(F.col("p_size") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("form"), "p_brand").distinct()
    want = orders.select("o_orderkey", (F.col("o_custkey") % 7).alias("arity"), F.col("o_orderpriority").alias("form")).join(fit, ["arity", "form"])
    assert got.count() == want.count() > 0
    assert all(abs(r[1] - 1) < 1e-6 for r in got.groupBy("hg_id").agg(F.sum("weight")).collect())


def test_choices_over_several_edges(spark):
    edges = [(1, 0, 2, "x"), (1, 1, 2, "x"), (1, 2, 3, "x"), (2, 0, 3, "x"), (3, 0, 4, "x"), (3, 1, 4, "x")]
    rules = [(0, 2, "x", 3), (1, 2, "x", 1), (2, 3, "x", 4), (3, 4, "x", 0), (4, 5, "x", 1)]
    e = spark.createDataFrame(edges, "hg_id long, edge int, arity int, form string")
    one = hypergraphs.choices(e, spark.createDataFrame(rules, "rule_id int, arity int, form string, count int"))
    # another row of a rule that fits nothing takes the way by windows
    two = hypergraphs.choices(e, spark.createDataFrame([*rules, (4, 6, "x", 1)], "rule_id int, arity int, form string, count int"))
    want = sorted((g, k, r, w) for g, k, r, w in [(1, 0, 0, 1.5 / 8), (1, 1, 0, 1.5 / 8), (1, 0, 1, 0.5 / 8), (1, 1, 1, 0.5 / 8), (1, 2, 2, 0.5), (2, 0, 2, 1.0), (3, 0, 3, 0.5), (3, 1, 3, 0.5)])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == want


def test_a_grammar_is_learnt_until_no_motif_is_left(spark):
    chain = lambda s: (dict(enumerate(s)), [(k, k + 1, "x") for k in range(len(s) - 1)])
    made = {1: chain("abcdefgh"), 2: chain("abccc"), 3: chain("ab"), 4: chain("z")}
    rules, anno, left = learning.learn(graphs(spark, made))
    got = [(r.src_label, r.dst_label, r.n_graphs) for r in rules.orderBy("rule_id").collect()]
    assert got == [("a", "b", 3), ("gray", "c", 2), ("gray", "d", 1), ("gray", "e", 1), ("gray", "f", 1), ("gray", "g", 1), ("gray", "h", 1)]
    steps = {g: [r.rule_id for r in anno.where(f"graph_id = {g}").orderBy("seq").collect()] for g in (1, 2, 3)}
    assert steps == {1: [0, 1, 2, 3, 4, 5, 6], 2: [0, 1, 1, 1], 3: [0]}
    assert sorted((r.graph_id, r.label) for r in left.nodes.collect()) == [(1, "gray"), (2, "gray"), (3, "gray"), (4, "z")]
    every = learning.grammar(graphs(spark, made)).orderBy("rule_id").collect()
    assert [r.n_graphs for r in every if r.form] == [3, 1] and [r.rule_id for r in every] == list(range(9))
    with pytest.raises(RuntimeError):
        learning.learn(graphs(spark, made), rounds=4)


def test_matches_without_neighbours_and_with_many_classes_are_realised(spark):
    star = {1: "A", 2: "N"} | {k: f"L{k}" for k in range(3, 13)}
    g = graphs(spark, {1: ({1: "A", 2: "N"}, [(1, 2, "black")]), 2: (star, [(1, 2, "black")] + [(2, k, "black") for k in range(3, 13)])})
    m = spark.createDataFrame([(1, 0, [1, 2]), (2, 0, [1, 2])], "graph_id long, ism_id int, nodes array<int>")
    r = instructions.realisations(g, m, 2).cache()
    assert [(x.dir_id, x.ins, x.outs) for x in r.where("graph_id = 1").collect()] == [(0, [], [])]
    many = r.where("graph_id = 2").collect()
    assert sorted(x.dir_id for x in many) == list(range(1 << 10))
    assert len({tuple(x.ins) for x in many}) == 1 << 10 and all(len(x.ins) == 10 for x in many)
    assert instructions.admitted(r, []).select("graph_id").collect()[0][0] == 1


def test_token_sequences_are_as_long_as_the_longest(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", "tool"][t % 3]) for c, n in ((1, 9), (2, 2)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.graph_id: (r.tokens, r["mask"]) for r in QUERIES["token_sequences"](spark, str(tmp_path)).collect()}
    assert got == {1: ("2 1 0 2 1 0 2 1 0", "1 1 1 1 1 1 1 1 1"), 2: ("1 0 9 9 9 9 9 9 9", "1 1 0 0 0 0 0 0 0")}
    with pytest.raises(Exception, match="3 tokens, but the length is 2"):
        spark.range(1).select(tokens.padded(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, 9)).collect()


def test_node_strings_give_whole_graphs_back(spark):
    rows = QUERIES["node_string"](spark, DIR).withColumn("row", F.split("row", "").cast("array<int>"))
    nodes, edges = tokens.from_node_strings(rows, ["A", "N", "R"])
    g = views.order_graphs(spark, DIR)
    assert g.nodes.where("node_id > 6").count() > 0
    for a, b in ((nodes, g.nodes), (edges, g.edges)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    with pytest.raises(Exception, match="beyond the length of 6"):
        tokens.node_strings(g.nodes, g.edges, ["A", "N", "R"], 6).collect()


@pytest.mark.parametrize("n", [2133, 900])
def test_the_split_is_at_the_exact_rank(spark, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    assert metrics.standardised(rows, "k", "v").where("is_train").count() == int(n * 0.9)


def test_ranks_of_far_keys(spark):
    keys = sorted([-(2**63), -7, -7, 0, 5, 5, 5, 10**12, 2**63 - 1])
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [metrics.nth(rows, "k", r, 16) for r in range(1, len(keys) + 1)] == keys
