"""Closures that follow changes of edges: only pairs that a change can touch are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftgraph.operators.checkpoints import cut

PAIR = ["graph_id", "src", "dst"]


def _through(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that a pair of left and then one of right join."""
    return left.withColumnRenamed("dst", "mid").join(right.withColumnRenamed("src", "mid"), ["graph_id", "mid"]).select(*PAIR)


def inserted(closed: DataFrame, added: DataFrame) -> DataFrame:
    """The closure with more edges(graph_id, src, dst): from the new pairs on, each round joins what was new in the last one with what is known."""
    known = closed.select(*PAIR)
    fresh = cut(added.select(*PAIR).distinct().join(known, PAIR, "left_anti"))
    while not fresh.isEmpty():
        known = cut(known.unionByName(fresh))
        more = _through(known, fresh).unionByName(_through(fresh, known)).distinct()
        fresh = cut(more.join(known, PAIR, "left_anti"))
    return known


def deleted(closed: DataFrame, left: DataFrame, gone: DataFrame) -> DataFrame:
    """The closure after gone(graph_id, src, dst) went and the edges left stay.

    Pairs that some path over a lost edge joins are doubtful; all others stay as they are. A doubtful pair comes
    back if an edge that is left joins it, or a pair that holds and such an edge do;
    what comes back may bring others back in the next round. Cycles are allowed.
    """
    known = closed.select(*PAIR)
    lost = cut(gone.select(*PAIR).distinct())
    ahead = cut(lost.unionByName(_through(known, lost)).distinct())  # from all that lead to a lost edge to its end
    doubtful = cut(ahead.unionByName(_through(ahead, known)).distinct())
    sure = cut(known.join(doubtful, PAIR, "left_anti"))
    edges = left.select(*PAIR).distinct()
    near = sure.join(doubtful.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_semi")
    fresh = cut(edges.unionByName(_through(near, edges)).distinct().join(doubtful, PAIR, "left_semi"))
    back = fresh
    while not fresh.isEmpty():
        fresh = cut(_through(fresh, edges).distinct().join(doubtful, PAIR, "left_semi").join(back, PAIR, "left_anti"))
        back = cut(back.unionByName(fresh))
    return sure.unionByName(back)


def maintained(closed: DataFrame, edges: DataFrame, added: DataFrame, gone: DataFrame) -> DataFrame:
    """The closure after some edges went and others came; edges are those of now."""
    left = edges.select(*PAIR).join(added.select(*PAIR), PAIR, "left_anti")
    return inserted(deleted(closed, left, gone), added)
