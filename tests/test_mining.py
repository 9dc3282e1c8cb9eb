import random
from collections import defaultdict
from itertools import combinations, permutations

from weftgraph.operators import mining
from weftgraph.sources.views import Graphs


def collection(spark, rng, n, nodes=7, density=0.3):
    ns, es = [], []
    for g in range(n):
        size = rng.randrange(1, nodes + 1)
        ns += [(g, i, rng.choice(["A", "B", None])) for i in range(size)]
        es += [(g, a, b, rng.choice(["x", "y"])) for a in range(size) for b in range(size) if a != b and rng.random() < density]
    nodes = spark.createDataFrame(ns, "graph_id long, node_id long, label string")
    return Graphs(nodes, spark.createDataFrame(es, "graph_id long, src long, dst long, label string")), ns, es


def brute(ns, es, most, least):
    """code -> (n_matches, n_graphs) by all node sets; codes by all orders."""
    labels, edges = defaultdict(dict), defaultdict(list)
    for g, i, x in ns:
        labels[g][i] = x or "#"
    for g, a, b, x in es:
        edges[g].append((a, b, x))
    found = defaultdict(list)
    for g, own in labels.items():
        for k in range(2, most + 1):
            for s in combinations(sorted(own), k):
                inside = [e for e in edges[g] if e[0] in s and e[1] in s]
                seen, front = {s[0]}, [s[0]]
                for n in front:
                    for a, b, _ in inside:
                        for x, y in ((a, b), (b, a)):
                            if x == n and y not in seen:
                                seen.add(y)
                                front.append(y)
                if len(seen) == k:
                    code = min((tuple(own[n] for n in p), sorted((p.index(a), p.index(b), x) for a, b, x in inside)) for p in permutations(s))
                    found[str(code)].append(g)
    return {c: (len(v), len(set(v))) for c, v in found.items() if len(set(v)) >= least}


def test_equals_all_node_sets(spark):
    g, ns, es = collection(spark, random.Random(1), 25)
    want = brute(ns, es, 5, 3)
    rows = mining.mine(g, most=5, least=3).collect()
    assert len({r.code for r in rows}) == len(rows)
    assert sorted((r.n_matches, r.n_graphs) for r in rows) == sorted(want.values())
    for r in rows:  # the first occurrence induces the motif
        own = {i: x or "#" for g2, i, x in ns if g2 == r.graph_id and i in r.nodes}
        at = {n: k for k, n in enumerate(r.nodes)}
        assert mining.code([own[n] for n in r.nodes], [(at[a], at[b], x) for g2, a, b, x in es if g2 == r.graph_id and a in at and b in at]) == r.code
        assert r.gain == r.n_graphs * (r.n_nodes - 1 + r.n_edges) - (r.n_nodes + r.n_edges)


def test_codes_tell_isomorphism():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 6)
        labels = [rng.choice("AB") for _ in range(n)]
        edges = [(a, b, "x") for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        p = rng.sample(range(n), n)
        moved = [None] * n
        for k in range(n):
            moved[p[k]] = labels[k]
        assert mining.code(moved, [(p[a], p[b], x) for a, b, x in edges]) == mining.code(labels, edges)
        if edges:
            assert mining.code(labels, edges[1:]) != mining.code(labels, edges)


def test_nothing_frequent_ends_early(spark):
    g, _, _ = collection(spark, random.Random(3), 3)
    assert mining.mine(g, most=4, least=99).isEmpty()
    assert mining.top(mining.mine(g, most=3, least=1), 2).count() <= 2
