import random

from pyspark.sql import functions as F

from weftgraph.operators import cliques
from weftgraph.sources.views import Graphs

SCHEMA = "graph_id long, ism_id long, dir_id int, ins array<string>, outs array<string>"


def made(spark, rng, graphs=12, kinds=6):
    """Graphs, matches and realisations with few instructions, so that many conflict."""
    ns, es, isms, real = [], [], [], []
    for g in range(graphs):
        size = rng.randrange(3, 9)
        ns += [(g, i, "A") for i in range(size)]
        es += [(g, i, j, "x") for i in range(size) for j in range(size) if i != j and rng.random() < 0.25]
        for m in range(rng.randrange(1, 6)):
            isms.append((g, m, sorted(rng.sample(range(size), 2))))
            for d in range(2):
                ins = rng.sample([f"i{k}" for k in range(kinds)], rng.randrange(3))
                outs = [x for x in rng.sample([f"i{k}" for k in range(kinds)], rng.randrange(3)) if x not in ins or rng.random() < 0.1]
                real.append((g, m, d, ins, outs))
    graph = Graphs(spark.createDataFrame(ns, "graph_id long, node_id long, label string"), spark.createDataFrame(es, "graph_id long, src long, dst long, label string"))
    return graph, es, spark.createDataFrame(isms, "graph_id long, ism_id long, nodes array<long>"), {(g, m): set(n) for g, m, n in isms}, spark.createDataFrame(real, SCHEMA), real


def clash(a, b, nodes, es, linear):
    if a[:2] == b[:2] or linear and a[0] == b[0]:
        return True
    if set(a[3]) & set(b[4]) or set(b[3]) & set(a[4]):
        return True
    if a[0] != b[0]:
        return False
    x, y = nodes[a[:2]], nodes[b[:2]]
    return bool(x & y) or any(g == a[0] and (s in x and d in y or s in y and d in x) for g, s, d, _ in es)


def test_equals_taking_one_by_one(spark):
    for seed, linear in ((1, True), (2, False), (3, False)):
        g, es, isms, nodes, realised, real = made(spark, random.Random(seed))
        order = {(r.graph_id, r.ism_id, r.dir_id): r.h for r in realised.select("*", F.xxhash64(F.lit(7), *cliques.NAMES).alias("h")).collect()}
        want = []
        for r in sorted(real, key=lambda r: (order[r[:3]], r[:3])):
            if not set(r[3]) & set(r[4]) and not any(clash(r, o, nodes, es, linear) for o in want):
                want.append(r)
        got = cliques.compatible(realised, isms, g, linear, cliques.seeded(7)).collect()
        assert sorted(map(tuple, (r[:3] for r in got))) == sorted(r[:3] for r in want)
        assert max(r["round"] for r in got) < len(want)  # several are taken at once


def test_best_of_seeds_and_motifs(spark):
    g, _, isms, _, realised, _ = made(spark, random.Random(4))
    sizes = [cliques.compatible(realised, isms, g, True, cliques.seeded(s)).count() for s in range(3)]
    assert cliques.best(realised, isms, g).count() == max(sizes)
    few = realised.where("graph_id < 2")
    name, chosen = cliques.embeddings({"few": (few, isms, 1), "all": (realised, isms, 1), "same": (realised, isms, 1), "none": (realised.where("false"), isms, 9)}, g)
    assert name == "all" and chosen.count() == sizes[0]
    assert cliques.embeddings({"none": (realised.where("false"), isms, 9)}, g) is None


def test_conflicts_inside_graphs_need_no_rounds(spark, monkeypatch):
    """Rows, rounds, and rows for small graphs beside rounds for large ones choose alike, in the same rounds."""
    es = [(k, i, i + 1, "x") for k in range(6) for i in range(5 if k % 2 else 14)]
    g = Graphs(spark.createDataFrame([(k, i, "A") for k in range(6) for i in range(15)], "graph_id long, node_id long, label string"), spark.createDataFrame(es, "graph_id long, src long, dst long, label string"))
    isms = g.edges.select("graph_id", F.col("src").alias("ism_id"), F.array("src", "dst").alias("nodes"))
    free = isms.select("graph_id", "ism_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("dir_id"), *[F.array().cast("array<string>").alias(c) for c in ("ins", "outs")])
    got, calls, real = [], [], cliques._in_rounds
    monkeypatch.setattr(cliques, "_in_rounds", lambda *a: calls.append(1) or real(*a))
    for local in (100, 10, 0):
        monkeypatch.setattr(cliques, "LOCAL", local)
        got.append(sorted((*r[:3], r["round"]) for r in cliques.compatible(free, isms, g, False).collect()))
        assert len(calls) == (0, 1, 2)[len(got) - 1]
    assert got[0] == got[1] == got[2] and max(r[3] for r in got[0]) > 1
