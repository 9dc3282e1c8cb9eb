"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, root: the least id of each component, for every id that links (a, b) names.

    Each round lets every id take the least root of its neighbours, moves whole
    trees along with their roots, and halves all paths; rounds needed grow with
    the logarithm of a component's width. Every step sums by id before it shuffles,
    and joins on ids, of which a hot one can be split. Null and equal ends are left out.
    """
    edges = cut(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        of = roots.select(F.col("id").alias("b"), F.col("root").alias("r"))
        near = both.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("near"))
        seen = roots.join(near, "id").select("id", "root", F.least("root", "near").alias("near"))
        # the old root, too, learns of the least root that any of its tree has seen
        told = seen.where("near < root").groupBy(F.col("root").alias("id")).agg(F.min("near").alias("told"))
        new = seen.join(told, "id", "left").select("id", "root", F.least("near", F.coalesce("told", "near")).alias("new"))
        up = new.select(F.col("id").alias("new"), F.col("new").alias("above"))
        new = cut(new.join(up, "new").select("id", "root", F.least("new", "above").alias("new")))
        moved = new.where("new < root").limit(1).count()
        roots = new.select("id", F.col("new").alias("root"))
        if not moved:
            return roots
    raise RuntimeError(f"components are not settled after {rounds} rounds")
