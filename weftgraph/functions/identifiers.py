"""Node names of the form graph:node, sets as keys, and new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix(name: Column) -> Column:
    """The graph's part of a name; null without a colon."""
    return F.when(F.contains(name, F.lit(":")), F.split_part(name, F.lit(":"), F.lit(1)))


def suffix(name: Column) -> Column:
    """The node's part of a name: what follows the last colon."""
    return F.substring_index(name, ":", -1)


def set_key(items: Column) -> Column:
    """A set as a sorted array without repeats."""
    return F.array_sort(F.array_distinct(items))


def next_ids(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new(graph_id, ord) with node ids that follow each graph's greatest."""
    last = nodes.groupBy("graph_id").agg(F.max("node_id").alias("last"))
    nth = F.row_number().over(W.partitionBy("graph_id").orderBy("ord"))
    return new.join(last, "graph_id", "left").withColumn("node_id", F.coalesce("last", F.lit(-1)) + nth).drop("last")
