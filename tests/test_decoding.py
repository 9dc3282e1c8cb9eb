import math

from pyspark.sql import functions as F

from weftgraph.operators.masks import decode, legal
from weftgraph.operators.rewriting import Graph, apply
from weftgraph.plans import fixtures
from weftgraph.plans.queries import _flag_rules

NT = fixtures.NONTERMINALS
WEIGHTS = {(None, 0): 2.0, (None, 9): 1.0, (0, 3): 3.0, (0, 6): 3.0, (0, 4): 1.0, (3, 4): 2.0, (3, 7): 1.0, (4, 4): 5.0, (4, 8): 1.0, (4, 9): 50.0}


def plain(seq, rules, most):
    """Greedy decoding of one state, a graph and a step at a time."""
    g, seq = Graph({0: "black"}, set()), list(seq)
    for k in seq:
        node = next(n for n, x in g.labels.items() if x in NT)
        g = apply(g, node, rules[k])[0]
    while any(x in NT for x in g.labels.values()) and len(seq) < most:
        ok = legal(g, rules, NT, len(seq), most)
        last = seq[-1] if seq else None
        fit = [(-WEIGHTS[last, k], k) for k in range(len(rules)) if ok[k] and (last, k) in WEIGHTS]
        if not fit:
            return seq, False
        seq.append(min(fit)[1])
        g = apply(g, next(n for n, x in g.labels.items() if x in NT), rules[seq[-1]])[0]
    return seq, not any(x in NT for x in g.labels.values())


def weights(spark):
    rows = [(a, b, w) for (a, b), w in WEIGHTS.items()] + [(0, 5, 0.0), (0, 77, 9.0), (1, 3, None)]
    return spark.createDataFrame(rows, "last int, rule int, weight double")


def test_greedy_decoding_equals_a_walk_of_each_state(spark):
    rules = _flag_rules()
    starts = [[], [0], [0, 3], [0, 4], [1], [2], [0, 6], [9]]
    states = spark.createDataFrame(list(enumerate(starts)), "id long, rules array<int>")
    for most in (3, 6):
        got = {r.id: (r.rules, r.ended) for r in decode(states, rules, NT, weights(spark), most).collect()}
        assert got == {i: plain(s, rules, most) for i, s in enumerate(starts)}
    assert decode(states.where("false"), rules, NT, weights(spark), 3).count() == 0


def test_draws_follow_the_weights_and_reruns_agree(spark):
    rules = _flag_rules()
    states = spark.range(2000).select("id", F.array().cast("array<int>").alias("rules"))
    a, b = (sorted((r.id, tuple(r.rules), r.ended) for r in decode(states, rules, NT, weights(spark), 2, seed=4).collect()) for _ in range(2))
    assert a == b and len(a) == 2000
    share = sum(r[1][0] == 0 for r in a) / 2000
    assert abs(share - 2 / 3) < 4 * math.sqrt(2 / 9 / 2000)
    # the second rule must end the chain
    assert {r[1] for r in a} == {(9,), (0, 6)} and all(r[2] for r in a)
