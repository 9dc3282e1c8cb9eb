"""Ratings of many items at once."""

import random
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.operators import tournaments


def _results(seed, items=200):
    rng = random.Random(seed)
    out = {}
    for k in range(items):
        players = rng.sample(range(100), rng.randrange(2, 12))
        for _ in range(rng.randrange(1, 25)):
            i, j = sorted(rng.sample(players, 2)) if rng.random() < 0.95 else [players[0]] * 2
            s = rng.choice([0.0, 0.2, 0.5, 0.9, 1.0])
            a, b = out.get((k - 50, i, j), (0.0, 0.0))
            out[k - 50, i, j] = (a + s, b + 1 - s)
    rows = [(*k, *v) for k, v in out.items()]
    rng.shuffle(rows)
    return rows


def test_items_renewed_together_get_the_ratings_of_each_alone():
    rows = _results(4)
    got = tournaments.all_strengths(*map(np.array, zip(*rows, strict=True)))
    per = defaultdict(list)
    for k, i, j, a, b in rows:
        per[k].append((i, j, a, b))
    want = {}
    for k, found in per.items():
        players = sorted({x for r in found for x in r[:2]})
        at = {p: n for n, p in enumerate(players)}
        one = tournaments.strengths(sorted((at[i], at[j], a, b) for i, j, a, b in found), len(players))
        want |= {(k, p): s for p, s in zip(players, one, strict=True)}
    assert {(k, p): s for k, p, s in zip(*(x.tolist() for x in got), strict=True)} == pytest.approx(want, rel=1e-9)
    assert tournaments.all_strengths(*[np.zeros(0, dtype=np.int64)] * 3, *[np.zeros(0)] * 2)[0].tolist() == []


def test_no_item_is_renewed_by_itself(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    real = tournaments.strengths
    monkeypatch.setattr(tournaments, "strengths", lambda *a: calls.add(1) or real(*a))
    got = tournaments.bradley_terry(spark.createDataFrame([(k, 1, 2, 0.75) for k in range(50)], "item long, i long, j long, s double")).collect()
    assert len(got) == 100 and calls.value == 0 and len({r.strength for r in got}) == 2


def test_turns_part_opponents_and_keep_their_order():
    i, j = np.array([0, 0, 1, 5, 4, 3]), np.array([1, 2, 2, 4, 3, 3])
    t = tournaments.turns(i, j, 6)
    assert t.tolist() == [0, 1, 2, 0, 1, 2]
