"""What a task holds does not grow with the input."""

import pytest

from tests.test_plans import plan
from weftgraph.operators import primitives, rules
from weftgraph.plans.queries import QUERIES
from weftgraph.sources import views

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["automorphism_dedupe", "parse_graphs", "clique_graph"])
def test_tasks_are_as_many_as_rows_need(spark, monkeypatch, name):
    monkeypatch.setattr(views, "ROWS", 500)
    df = QUERIES[name](spark, DIR)
    assert df.rdd.getNumPartitions() >= 12 and "Exchange" in plan(df)


def test_bonds_are_paired_without_a_shuffle_of_pairs(spark):
    bonds = spark.createDataFrame([(1, 1, [1, 2]), (1, 1, [7]), (1, 2, [2, None]), (1, 3, None), (1, 4, [7, 7]), (1, 5, [None]), (2, 1, [1]), (None, 1, [1]), (None, 2, [1])], "mol long, bond long, atoms array<long>")
    rings = spark.createDataFrame([(1, 9, 3), (1, 9, 5), (1, None, 1), (1, None, 2), (3, 1, 8), (3, 1, 9), (3, 1, 9)], "mol long, ring long, bond long")
    got = primitives.clique_graph(bonds, rings)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 1, 4), (1, 3, 5), (3, 8, 9)]
    assert "Join" not in plan(got)


def test_steps_of_one_rule_are_not_one_tasks(spark):
    steps = spark.createDataFrame([(g, s, r) for g in (1, 2) for s, r in ((0, 0), (1, 1), (2, 2))], "graph_id long, seq int, rule_id int")
    table = spark.createDataFrame([(0, ["a", "N"], [(0, 1, "x")]), (1, ["b", "N"], [(0, 1, "y"), (1, 0, "z")]), (2, ["c"], None)], "rule_id int, labels array<string>, edges array<struct<a:int,b:int,x:string>>")
    edges = rules.parse_graph(steps, table)[1]
    assert sorted(map(tuple, edges.where("graph_id = 2").drop("graph_id").collect()), key=str) == sorted([(1, 0, 0, 0, 1, "x"), (1, 1, 0, 1, 1, "y"), (1, 1, 1, 1, 0, "z"), (2, 0, 1, 1, 0, None), (2, 1, 1, 2, 0, None)], key=str)
    assert "rule_id" not in "".join(x for x in plan(edges).splitlines() if "hashpartitioning" in x)
