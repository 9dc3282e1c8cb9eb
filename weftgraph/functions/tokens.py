"""Sequences and graphs as rows of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(label: Column, alphabet: list[str]) -> Column:
    """1 at the label's place in the alphabet, 0 elsewhere."""
    return F.array(*[(label == x).cast("int") for x in alphabet])


def padded(tokens: Column, length: int, pad: int) -> Column:
    """tokens, filled with pad to the length; longer ones raise."""
    long = F.raise_error(F.concat(F.size(tokens).cast("string"), F.lit(f" tokens, but the length is {length}"))).cast("int")
    rest = F.when(F.size(tokens) <= length, F.lit(length) - F.size(tokens)).otherwise(long)
    return F.concat(tokens, F.array_repeat(F.lit(pad), rest))


def mask(tokens: Column, length: int) -> Column:
    """1 for each place of padded() that holds a token."""
    if length < 1:
        return F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: (k <= F.size(tokens)).cast("int"))


def longest(sequences: DataFrame, tokens: str) -> int:
    """The greatest number of tokens of a row."""
    return sequences.agg(F.max(F.size(tokens))).first()[0] or 0


def dense_tokens(rules: DataFrame) -> DataFrame:
    """rule_id, token: rules(rule_id) numbered from 0 in the order of their ids; a rule table is small by nature."""
    from pyspark.sql import Window as W

    return rules.select("rule_id").distinct().withColumn("token", F.row_number().over(W.orderBy("rule_id")) - 1)


def rule_sequences(anno: DataFrame) -> DataFrame:
    """graph_id, rules: the rules of anno(graph_id, seq, rule_id) in reverse order of their recording."""
    return anno.groupBy("graph_id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule_id"))), lambda x: x["rule_id"])).alias("rules"))


def node_strings(nodes: DataFrame, edges: DataFrame, alphabet: list[str], length: int | None = None) -> DataFrame:
    """graph_id, node_id, row: label one-hot, then 1 for each earlier node from 1 that an edge leads from; for all nodes from 1.

    Rows of all graphs are as wide as length asks for, by default that of the greatest node; nodes beyond it raise.
    """
    if length is None:
        length = max(1, nodes.agg(F.max("node_id")).first()[0] or 1)
    beyond = F.raise_error(F.concat(F.lit("node "), F.col("node_id").cast("string"), F.lit(f" is beyond the length of {length}"))).cast("boolean")
    few = nodes.where(F.when(F.col("node_id") <= length, F.col("node_id") >= 1).otherwise(beyond))
    into = edges.where("src < dst").groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.collect_set("src").alias("from"))
    rows = few.join(into, ["graph_id", "node_id"], "left")
    linked = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda k: F.coalesce(F.array_contains("from", k), F.lit(False)).cast("int")) if length > 1 else F.array().cast("array<int>")
    return rows.select("graph_id", "node_id", F.concat(one_hot(F.col("label"), alphabet), linked).alias("row"))


def from_node_strings(rows: DataFrame, alphabet: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node_strings()."""
    n = len(alphabet)
    label = F.element_at(F.array(*map(F.lit, alphabet)), F.array_position(F.slice("row", 1, n), 1).cast("int"))
    nodes = rows.select("graph_id", "node_id", label.alias("label"))
    bits = F.posexplode(F.slice(F.col("row"), n + 1, F.size("row") - n)).alias("k", "bit")
    edges = rows.select("graph_id", F.col("node_id").alias("dst"), bits).where("bit = 1").select("graph_id", (F.col("k") + 1).alias("src"), "dst", F.lit("black").alias("label"))
    return nodes, edges
