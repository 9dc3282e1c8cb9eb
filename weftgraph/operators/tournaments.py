"""Rankings from pairwise results, by item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut


def strengths(results: list[tuple[int, int, float, float]], n: int, rounds: int = 100, tolerance: float = 1e-6) -> list[float]:
    """Ratings of n players from (i, j, shares that i won of j, shares that j won of i): each is renewed in turn, until none moves much.

    A player's rating becomes the shares it won over the sum of these and, for each opponent, the shares
    lost times the ratio of the opponent's rating to its own. Ratings aren't rescaled; a player
    without any share has 0.
    """
    lost: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    won = [0.0] * n
    for i, j, a, b in results:
        won[i] += a
        won[j] += b
        lost[i].append((j, b))
        lost[j].append((i, a))
    p = [1.0] * n
    for _ in range(rounds):
        old = p[:]
        for i in range(n):
            if won[i] and p[i]:
                p[i] = won[i] / (won[i] + sum(x * p[j] for j, x in lost[i]) / p[i])
            elif lost[i]:
                p[i] = 0.0
        if max((abs(x - y) for x, y in zip(p, old, strict=True)), default=0) < tolerance:
            break
    return p


def turns(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The turn of each of n players: opponents (i, j) never share one, and those of lower number come first, so players of one turn may be renewed at once."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    low, high = low[low < high], high[low < high]
    by = np.argsort(low, kind="stable")
    high, begin = high[by], np.searchsorted(low[by], np.arange(n + 1))
    wait, turn = np.bincount(high, minlength=n), np.zeros(n, dtype=np.int64)
    front, t = np.flatnonzero(wait == 0), 0
    while len(front):
        turn[front] = t
        heads, k = np.unique(high[_ranges(begin[front], begin[front + 1])], return_counts=True)
        wait[heads] -= k
        front, t = heads[wait[heads] == 0], t + 1
    return turn


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin to before its end, one range after the other."""
    size = end - begin
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())


def all_strengths(item: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, player, rating of strengths() for many items at once, from results (item, i, j, a, b).

    Players that don't meet don't wait for each other: a round renews all players of one turn, of all items,
    then those of the next, which gives what renewal one by one does. Each item stops by itself.
    """
    where, player = np.concatenate([item, item]), np.concatenate([i, j])
    order = np.lexsort((player, where))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(where[order]) != 0) | (np.diff(player[order]) != 0)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    items, players = where[order][new], player[order][new]
    n, m = len(items), len(item)
    me, other, lost = np.concatenate([at[:m], at[m:]]), np.concatenate([at[m:], at[:m]]), np.concatenate([b, a])
    won = np.bincount(me, np.concatenate([a, b]), minlength=n)
    turn = turns(at[:m], at[m:], n)
    by = np.lexsort((other, me, turn[me]))
    me, other, lost = me[by], other[by], lost[by]
    own = np.cumsum(np.concatenate([[True], np.diff(items) != 0])) - 1 if n else items

    def plan(left: np.ndarray) -> list[tuple]:
        """For each turn the players left, their opponents, the shares lost to them, where each player's begin, and the shares won."""
        keep = left[me]
        x, y, z = me[keep], other[keep], lost[keep]
        edge = np.searchsorted(turn[x], np.arange(turn.max(initial=-1) + 2))
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi > lo:
                begin = np.flatnonzero(np.concatenate([[True], np.diff(x[lo:hi]) != 0]))
                who = x[lo:hi][begin]
                out.append((who, y[lo:hi], z[lo:hi], begin, won[who]))
        return out

    p, rating = np.ones(n), np.ones(n)
    left, live = np.ones(n, dtype=bool), n
    steps, starts = plan(left), np.flatnonzero(np.concatenate([[True], np.diff(own) != 0])) if n else np.zeros(0, dtype=np.int64)
    for _ in range(rounds if n else 0):
        old = p.copy()
        for who, foes, shares, begin, mine in steps:
            now = p[who]
            with np.errstate(divide="ignore", invalid="ignore"):
                p[who] = np.where((mine != 0) & (now != 0), mine / (mine + np.add.reduceat(shares * p[foes], begin) / now), 0.0)
        rating[left] = p[left]
        left &= ~(np.maximum.reduceat(np.abs(p - old), starts) < tolerance)[own]
        count = int(left.sum())
        if not count:
            break
        if count * 4 < live * 3:
            steps, live = plan(left), count
    return items, players, rating


def bradley_terry(matches: DataFrame) -> DataFrame:
    """matches(item, i, j, s): item, player, strength.

    Games of a pair are summed before anything travels, so an item's row grows with its
    pairs of players, not with their games. An item is one task's; the items of a batch are renewed together.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            item = np.repeat(batch["item"].to_numpy(), batch["i"].value_lengths().to_numpy())
            got = all_strengths(item, *(batch[c].flatten().to_numpy() for c in ("i", "j", "a", "b")))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["item", "player", "strength"])

    one, two = F.least("i", "j"), F.greatest("i", "j")
    share = F.when(F.col("i") <= F.col("j"), F.col("s")).otherwise(1 - F.col("s"))
    pairs = matches.groupBy(F.col("item").cast("long").alias("item"), one.cast("long").alias("i"), two.cast("long").alias("j")).agg(F.sum(share).alias("a"), F.sum(1 - share).alias("b"))
    rows = pairs.groupBy("item").agg(F.collect_list(F.struct("i", "j", "a", "b")).alias("m")).select("item", *[F.col(f"m.{c}").alias(c) for c in ("i", "j", "a", "b")])
    return rows.mapInArrow(run, "item long, player long, strength double")


def round_robin(players: DataFrame) -> DataFrame:
    """item, i, j: each pair of players(item, player) of an item once."""
    return players.withColumnRenamed("player", "i").join(players.withColumnRenamed("player", "j"), "item").where("i < j")


def swiss_round(standing: DataFrame) -> DataFrame:
    """item, board, i, j: players(item, player, score) paired by standing; with an odd number the last has no partner."""
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "player")) - 1
    boards = standing.withColumn("r", rank).groupBy("item", F.floor(F.col("r") / 2).alias("board"))
    return boards.agg(F.min_by("player", "r").alias("i"), F.max_by("player", "r").alias("j"), F.count("*").alias("n")).select("item", "board", "i", F.when(F.col("n") == 2, F.col("j")).alias("j"))


def swiss(players: DataFrame, beats, rounds: int = 4) -> DataFrame:
    """item, player, score after rounds of swiss_round(); beats(i, j) is a column: the share of a match that i wins. A bye scores 1."""
    standing = players.withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        won = F.when(F.col("j").isNull(), 1.0).otherwise(beats(F.col("i"), F.col("j")))
        games = swiss_round(standing).withColumn("s", won)
        points = games.select("item", F.col("i").alias("player"), F.col("s").alias("p")).unionByName(games.where("j IS NOT NULL").select("item", F.col("j").alias("player"), (1 - F.col("s")).alias("p")))
        # standings are read twice a round
        standing = cut(standing.join(points, ["item", "player"]).select("item", "player", (F.col("score") + F.col("p")).alias("score")))
    return standing


def winners(scores: DataFrame) -> DataFrame:
    """player, n_items: how many items each player is the best of; ties to the smaller player."""
    best = scores.groupBy("item").agg(F.max_by("player", F.struct("score", -F.col("player"))).alias("player"))
    return best.groupBy("player").agg(F.count("*").alias("n_items"))
