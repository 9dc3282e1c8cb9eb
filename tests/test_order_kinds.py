"""Different order graphs are found by their labels, and dealt by their number where each costs Python."""

import json
from collections import Counter

import pytest

from tests.test_plans import plan
from weftgraph.operators import hrg
from weftgraph.plans import hrg_queries
from weftgraph.sources import views

DIR = "/root/testdata/sf0.001"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def written(spark, path, orders):
    lines = [(g, i, 7, 7, x) for g, labels in orders for i, x in enumerate(labels)]
    spark.createDataFrame(lines[::-1], LINES).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_order_kinds_are_the_kinds_of_order_graphs(spark, tmp_path):
    odd = written(spark, tmp_path, [(1, "ANA"), (2, ["A", None, "A"]), (3, ["A", None, "A"]), (4, [None]), (5, ["N"]), (6, "AAAAN"), (0, "ANA"), (9, [None, None, "R"]), (8, ["#"])])
    for sf_dir in (DIR, odd):
        assert rows(hrg.kinds(views.order_kinds(spark, sf_dir))) == rows(hrg.kinds(views.order_graphs(spark, sf_dir)))
    assert {(r.graph_id, r.often) for r in views.order_kinds(spark, odd).collect()} == {(0, 2), (2, 2), (4, 1), (5, 1), (6, 1), (8, 1), (9, 1)}


def test_lines_without_an_order_are_a_graph_as_in_sql(spark, tmp_path):
    sf_dir = written(spark, tmp_path, [(None, "ANA"), (1, "AN"), (2, "R")])
    assert rows(hrg_queries.hrg_chain_rules(spark, sf_dir)) == [("N1", 1), ("S", 3)]


def test_rules_are_counted_as_one_graph_after_the_other_would(spark):
    forms, uses, graphs = {}, Counter(), Counter()
    known = hrg.hypergraphs(views.order_graphs(spark, DIR)).collect()
    for r in known:
        forms[r.form] = min(r.hg, forms.get(r.form, r.hg))
    for r in known:
        mine = Counter((symbol, len(rhs["ext"]), hrg.form_of(rhs)) for symbol, rhs in hrg.rules_of(json.loads(forms[r.form])))
        uses += mine
        graphs.update(mine.keys())
    got = hrg.learn(hrg.kinds(views.order_kinds(spark, DIR))).collect()
    assert {(r.symbol, r.arity, r.form): (r["count"], r.n_graphs) for r in got} == {k: (n, graphs[k]) for k, n in uses.items()}


@pytest.mark.parametrize("name", ["generate_graphs", "hrg_chain_rules"])
def test_queries_make_no_graph_for_each_order(spark, monkeypatch, name):
    monkeypatch.setattr(views, "order_graphs", None)
    assert getattr(hrg_queries, name)(spark, DIR).count() == {"generate_graphs": 25, "hrg_chain_rules": 2}[name]


def test_python_is_dealt_by_graphs(spark, monkeypatch):
    monkeypatch.setattr(views, "GRAPHS", 20)
    for g in (views.order_graphs(spark, DIR), views.order_kinds(spark, DIR)):
        few = hrg.kinds(g)
        n = few.count()
        assert n > 200 and few.rdd.getNumPartitions() == -(-n // 20)
    forms = few.select("form").distinct().count()
    assert f", {-(-forms // 20)}), REPARTITION_BY_NUM" in plan(hrg.learn(few))
