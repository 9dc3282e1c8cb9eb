"""Production strings: right-hand sides written as edges `(a,b,c:N)` and `(a,b:T)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(rules: DataFrame) -> DataFrame:
    """rule_id, pos, nodes, is_nonterminal of the edges of rules(rule_id, text), in their order.

    Edges stand between `)(`, an edge's kind after its colon; what has no kind N or T is no edge.
    """
    parts = F.split(F.regexp_replace(F.trim("text"), r"^\(|\)$", ""), r"\)\(")
    pairs = F.transform(parts, lambda x: F.struct(F.split(F.split_part(x, F.lit(":"), F.lit(1)), ",").alias("nodes"), F.split_part(x, F.lit(":"), F.lit(2)).alias("kind")))
    known = F.filter(pairs, lambda x: x["kind"].isin("N", "T"))
    return rules.select("rule_id", F.posexplode(known).alias("pos", "e")).select("rule_id", "pos", F.col("e.nodes").alias("nodes"), (F.col("e.kind") == "N").alias("is_nonterminal"))


def symbols(rules: DataFrame) -> DataFrame:
    """symbol, n_rules of rules(rule_id, symbol)."""
    return rules.groupBy("symbol").agg(F.countDistinct("rule_id").alias("n_rules"))


def nth_rule(rules: DataFrame, n: int) -> DataFrame:
    """The rule n (from 0) of each symbol, by rule_id."""
    from pyspark.sql import Window as W

    return rules.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy("rule_id")) - 1).where(F.col("_n") == n).drop("_n")
