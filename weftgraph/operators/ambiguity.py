"""Making a grammar unambiguous over tables of derivations: rules to delete so that graphs are left with one derivation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut


def _uses(ways: DataFrame) -> DataFrame:
    """graph_id, rule, n: how many of a graph's derivations use each rule."""
    return ways.select("graph_id", F.explode("used").alias("rule")).groupBy("graph_id", "rule").agg(F.count("*").alias("n"))


def _added(table: DataFrame, change: DataFrame, keys: list[str], count: str) -> DataFrame:
    """table less the counts of change, without rows that come to nothing."""
    both = table.unionByName(change.withColumn(count, -F.col(count)))
    return both.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def deletions(ways: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """ways(graph_id, way, rules ARRAY), a row for each derivation: the deleted rules (rule, round), and what each graph has left.

    The second has graph_id, way, rules, n_left for every graph: the one derivation that is left, or nulls
    where several are, of which no deletion could single one out. Every graph that has a
    derivation keeps one at least.

    Set cover by greed: the derivations of graphs that have several are what is to be covered, a rule
    covers those that use it, and a rule that all derivations of some graph use stays. The
    rule that covers most goes first, of equal ones the least. A rule goes as soon as no
    rule of greater weight shares a graph with it: what other rules do
    cannot change its turn, so a round deletes many rules and the outcome is that of one after the other.
    Derivations that go are taken off the counts of their graphs and rules; nothing is counted anew.
    Rules are held against graphs by joins on the graph or the rule alone, after counts are summed.
    """
    left = cut(ways.select("graph_id", "way", "rules", F.array_distinct(F.filter("rules", lambda x: x.isNotNull())).alias("used")))
    uses = cut(_uses(left))
    sizes = cut(left.groupBy("graph_id").agg(F.count("*").alias("size")))
    gone: DataFrame | None = None
    for k in range(most):
        held = uses.join(sizes, "graph_id")
        # of each rule: whether a graph needs it, and what it covers in graphs that are still ambiguous
        rated = held.groupBy("rule").agg(F.max((F.col("n") == F.col("size")).cast("int")).alias("needed"), F.sum(F.when(F.col("size") > 1, F.col("n")).otherwise(0)).alias("weight"))
        free = cut(rated.where("needed = 0 AND weight > 0").select("rule", "weight"))
        if free.isEmpty():
            break
        rank: Column = F.struct((-F.col("weight")).alias("weight"), "rule")
        near = uses.select("graph_id", "rule").join(free, "rule")
        first = near.groupBy("graph_id").agg(F.min(rank).alias("first"))
        picks = near.join(first, "graph_id").groupBy("rule").agg(F.min((F.col("first.rule") == F.col("rule")).cast("int")).alias("own")).where("own = 1")
        picks = cut(picks.select("rule", F.lit(k).alias("round")))
        gone = picks if gone is None else gone.unionByName(picks)
        hit = left.select("graph_id", "way", F.explode("used").alias("rule")).join(picks.select("rule"), "rule", "left_semi").select("graph_id", "way").distinct()
        lost = cut(left.join(hit, ["graph_id", "way"], "left_semi"))
        left = cut(left.join(hit, ["graph_id", "way"], "left_anti"))
        uses = cut(_added(uses, _uses(lost), ["graph_id", "rule"], "n"))
        sizes = cut(_added(sizes, lost.groupBy("graph_id").agg(F.count("*").alias("size")), ["graph_id"], "size"))
    else:
        raise RuntimeError(f"rules are left to delete after {most} rounds")
    one = left.groupBy("graph_id").agg(F.count("*").alias("n_left"), F.min(F.struct("way", "rules")).alias("x"))
    only = lambda c: F.when(F.col("n_left") == 1, F.col(c))
    kept = one.select("graph_id", only("x.way").alias("way"), only("x.rules").alias("rules"), "n_left")
    if gone is None:
        gone = uses.where("false").select("rule", F.lit(0).alias("round"))
    return gone, kept


def listed(found: DataFrame) -> DataFrame:
    """ways for deletions() from all_derivations(): graph_id, way, rules."""
    return found.select("graph_id", F.posexplode("derivations").alias("way", "rules"))
