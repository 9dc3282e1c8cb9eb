"""Questions are answered by the first way that holds, for each different graph once, and come to further rounds only where steps run out."""

import json
import random
import re

import pytest

from tests.oracle import compare, connect
from tests.test_hrg import collection, some_graphs
from tests.test_order_kinds import DIR, LINES
from tests.test_plans import plan
from weftgraph.operators import hrg
from weftgraph.operators.asking import Search
from weftgraph.operators.hypergraphs import derives, hypergraph
from weftgraph.plans.queries import QUERIES, SQL
from weftgraph.sources import views

#: Rules that ask the same of themselves, derive nothing, or swap ends.
ODD = [
    ("N1", hypergraph(0, 1, [(["e0"], "N1"), (["e0"], "N1")])),
    ("N1", hypergraph(0, 1, [])),
    ("N2", hypergraph(0, 2, [(["e1", "e0"], "N2")])),
    ("N2", hypergraph(1, 2, [(["e1", "n0"], "N2"), (["n0", "n0"], "N2")])),
    ("S", hypergraph(2, 0, [(["n0"], "never")])),
]


def hypergraphs(rng, n, most=6):
    ns, es = some_graphs(rng, n, most)
    return [hrg.hypergraph_of({i: x for k, i, x in ns if k == g}, [(i, j, x) for k, i, j, x in es if k == g]) for g in range(n)]


def taught(rng, hgs, odd):
    rules = {(s, hrg.form_of(r)): {"symbol": s, "rhs": r} for hg in hgs for s, r in hrg.rules_of(hg)}
    some = [r for r in rules.values() if not odd or rng.random() < 0.8] + [{"symbol": s, "rhs": r} for s, r in ODD if odd]
    rng.shuffle(some)
    return {"N": ["S", *(f"N{k}" for k in range(6))], "S": "S", "rules": some}


def test_search_agrees_with_the_plain_one():
    rng, seen = random.Random(4), set()
    for k in range(40):
        hgs = hypergraphs(rng, 8)
        grammar = taught(rng, hgs[:4], k % 2)
        search = Search(grammar)  # knows the answers to the hypergraphs before
        for hg in hgs:
            want = derives(grammar, hg)
            assert search.answer("S", hg, 10**6) is want and Search(grammar).answer("S", hg, 3) in (want, None)
            seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("ahead", [0, 2])
def test_rounds_go_on_where_steps_run_out(spark, monkeypatch, ahead):
    monkeypatch.setattr(hrg, "AHEAD", ahead)
    monkeypatch.setattr(hrg, "ROWS", 3)
    rng = random.Random(5)
    hgs = dict(enumerate(hypergraphs(rng, 12)))
    grammar = taught(rng, [hgs[k] for k in range(6)], True)
    got = {int(r.graph_id): r.member for r in hrg.members(collection(spark, {str(k): h for k, h in hgs.items()}), grammar).collect()}
    assert got == {k: derives(grammar, h) for k, h in hgs.items()} and len(set(got.values())) == 2


def test_a_graph_takes_about_as_many_steps_as_it_has_nodes():
    labels = dict(enumerate("ANRAARNANRANNRRARANAANRARNANAR" * 20))
    whole = hrg.hypergraph_of(labels, [(k, k + 1, "x") for k in range(len(labels) - 1)])
    grammar = {"N": ["S", "N1"], "S": "S", "rules": [{"symbol": s, "rhs": r} for s, r in hrg.rules_of(whole)]}
    assert Search(grammar).answer("S", whole, 2 * len(labels)) is True


def written(spark, path, orders):
    rows = [(g, i, 7, 7, x) for g, labels in orders for i, x in enumerate(labels)]
    spark.createDataFrame(rows[::-1], LINES).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_odd_orders_are_derived_as_in_sql(spark, tmp_path):
    big = 2**62 + 1
    sf_dir = written(spark, tmp_path, [(None, "ANA"), (1, ["A", None, "A"]), (2, ["A", None, "A"]), (3, [None]), (4, ["S"]), (5, ["N1", "S", "N1"]), (6, ["black", "="]), (big, "NA"), (big + 1, "ANA"), (7, [""]), (8, "AN" * 60)])
    con = connect(sf_dir)
    con.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet/*.parquet'")
    df = QUERIES["hrg_round_trip"](spark, sf_dir)
    assert compare(df, con, SQL["hrg_round_trip"]) is None and df.count() == 11


@pytest.mark.parametrize("name", ["hrg_round_trip", "hrg_membership"])
def test_different_orders_are_asked_once(spark, monkeypatch, name):
    monkeypatch.setattr(views, "order_graphs", None)  # no graph is made for each order
    asked, members = [], hrg.members
    monkeypatch.setattr(hrg, "members", lambda known, grammar: asked.append(known) or members(known, grammar))
    df = QUERIES[name](spark, DIR)
    labels = views.order_labels(spark, DIR)
    assert asked[0].count() == labels.select("labels").distinct().count() < labels.count() == df.count()
    assert len(re.findall("mapInPandas|MapInPandas", plan(df))) == 0  # what is left is a join of answers to orders


def test_questions_are_dealt_by_their_number(spark, monkeypatch):
    hgs = {str(k): hg for k, hg in enumerate(hypergraphs(random.Random(6), 60, 7))}
    grammar, dealt, apart = taught(random.Random(7), list(hgs.values()), False), [], hrg.apart
    monkeypatch.setattr(views, "GRAPHS", 5)
    monkeypatch.setattr(hrg, "apart", lambda df, key: dealt.append(apart(df, key)) or dealt[-1])
    known = collection(spark, hgs)
    assert all(r.member for r in hrg.members(known, grammar).collect())
    assert dealt[0].rdd.getNumPartitions() == -(-len({hrg.form_of(h) for h in hgs.values()}) // 5) and json.loads(dealt[0].first().hg)
