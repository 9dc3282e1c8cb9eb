import random
from itertools import combinations

from weftgraph.operators import ambiguity, derivations
from weftgraph.operators.rewriting import Rule, derive

NT = {"gray", "black"}


def one_by_one(ways):
    """The same choice, a rule at a time over plain lists."""
    left, gone = {g: list(w) for g, w in ways.items()}, []
    while True:
        weight = {}
        for w in left.values():
            for r in {r for d in w for r in d}:
                n = sum(r in d for d in w)
                weight[r] = weight.get(r, 0) + (n if len(w) > 1 else 0) - (10**6 if n == len(w) else 0)
        free = sorted((-n, r) for r, n in weight.items() if n > 0)
        if not free:
            return set(gone), left
        gone.append(free[0][1])
        left = {g: [d for d in w if gone[-1] not in d] for g, w in left.items()}


def table(spark, ways):
    rows = [(g, k, list(d)) for g, w in ways.items() for k, d in enumerate(w)]
    return spark.createDataFrame(rows, "graph_id long, way int, rules array<int>")


def random_ways(seed):
    rng = random.Random(seed)
    return {g: [tuple(rng.randrange(14) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5))] for g in range(25)}


def test_rounds_equal_one_rule_after_the_other(spark):
    for seed in range(3):
        ways = random_ways(seed)
        gone, kept = ambiguity.deletions(table(spark, ways))
        want, left = one_by_one(ways)
        assert {r.rule for r in gone.collect()} == want and want
        got = {r.graph_id: r for r in kept.collect()}
        assert set(got) == set(ways) and {g: r.n_left for g, r in got.items()} == {g: len(w) for g, w in left.items()}
        assert all(r.rules is None if r.n_left > 1 else tuple(r.rules) == left[g][0] for g, r in got.items())
        # what stays ambiguous can't be told apart by any rule that all graphs can spare
        needed = {r for w in left.values() for r in set.intersection(*map(set, w))}
        assert all(set(d) <= needed for w in left.values() if len(w) > 1 for d in w)


def test_as_few_rules_go_as_the_beam_and_the_least_cover_delete(spark):
    emb = frozenset({("a", "black", "black", 0, "in", "in")})
    rules = [Rule("black", ("a", "gray"), ((0, 1, "black"),)), Rule("gray", ("a", "gray"), ((0, 1, "black"),), emb), Rule("gray", ("a",), (), emb), Rule("gray", ("a", "a"), ((0, 1, "black"),), emb)]
    made = [(n, derive(rules, [0, *[1] * n, 2], NT)) for n in range(4)]
    rows = [(n, [(k, x) for k, x in g.labels.items()], sorted(g.edges)) for n, g in made]
    df = spark.createDataFrame(rows, "graph_id long, nodes array<struct<node_id:int,label:string>>, edges array<struct<src:int,dst:int,label:string>>")
    found = derivations.all_derivations(df, rules, NT)
    gone, kept = ambiguity.deletions(ambiguity.listed(found))
    ways = {r.graph_id: r.derivations for r in found.collect()}
    beam, settled, lost = derivations.resolve([(n, len(g.labels), ways[n]) for n, g in made])
    assert {r.rule for r in gone.collect()} == beam and {r.graph_id: r.rules for r in kept.collect()} == settled and not lost
    # alone, a graph's derivations are told apart by as few rules as any set that leaves it one
    for seed in range(4):
        rng = random.Random(seed)
        ways = [tuple(rng.sample(range(8), 3)) for _ in range(4)]
        gone, kept = ambiguity.deletions(table(spark, {0: ways}))
        n = gone.count()
        fits = [c for k in range(9) for c in combinations(range(8), k) if sum(not set(c) & set(w) for w in ways) == 1]
        assert kept.first().n_left == 1 and len(fits[0]) <= n <= len(fits[0]) + 1


def test_edges_of_the_input(spark):
    ways = {1: [(0,)], 2: [(0, 1), (1, 0)], 3: [(), (5,)], 4: [(7, 7, 8), (7, 8)]}
    gone, kept = ambiguity.deletions(table(spark, ways))
    assert {r.rule for r in gone.collect()} == {5}
    assert {r.graph_id: (r.rules, r.n_left) for r in kept.collect()} == {1: ([0], 1), 2: (None, 2), 3: ([], 1), 4: (None, 2)}
    gone, kept = ambiguity.deletions(table(spark, ways).where("graph_id = 9"))
    assert gone.count() == 0 and kept.count() == 0
