"""Queries of hyperedge replacement grammars over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import hrg
from weftgraph.operators.checkpoints import cut, kept
from weftgraph.operators.shapes import small
from weftgraph.plans import fixtures
from weftgraph.plans.registry import ORDERS, query
from weftgraph.sources import views


def _paths(kinds: DataFrame) -> DataFrame:
    """The lines of each order as a path."""
    return kinds.withColumn("edges", F.filter("edges", lambda e: e["dst"] == e["src"] + 1))


def _terminals(kinds: DataFrame) -> DataFrame:
    """With labels of nodes that no nonterminal has."""
    return kinds.withColumn("nodes", F.transform("nodes", lambda n: n.withField("label", F.concat(F.lit("="), n["label"]))))


def _of_orders(spark, sf_dir, shape: Callable[[DataFrame], DataFrame], grammar: Callable[[DataFrame], dict]) -> DataFrame:
    """graph_id, member of each order: its graph as shape(order_kinds()) has it, asked of grammar(hypergraphs of the different graphs). Orders of equal labels are asked as one."""
    orders = kept(views.order_labels(spark, sf_dir))
    kinds = cut(shape(views.order_kinds(spark, sf_dir, orders)).withColumn("graph_id", F.monotonically_increasing_id()))
    known = cut(hrg.kinds(kinds))
    found = kinds.select("graph_id", "labels").join(hrg.members(known, grammar(known)), "graph_id")
    return orders.join(small(cut(found.select("labels", "member"))), "labels").select("graph_id", "member")


@query(f"WITH {ORDERS} SELECT g AS graph_id, list(lab ORDER BY i) = list(lab ORDER BY i DESC) AS member FROM n GROUP BY g")
def hrg_membership(spark, sf_dir):
    """Which orders a grammar of palindromes derives."""
    return _of_orders(spark, sf_dir, _paths, lambda _: fixtures.palindromes(["A", "N", "R"]))


@query(f"""WITH {ORDERS}, seq AS (SELECT g, list(lab ORDER BY i) AS s FROM n GROUP BY g)
SELECT CASE WHEN len(s) = 1 THEN 'S' ELSE CASE WHEN k = 1 THEN 'S' ELSE 'N1' END END AS symbol, CAST(count(*) AS BIGINT) AS count
FROM seq, range(1, 100) AS r(k) WHERE k <= greatest(len(s) - 1, 1) GROUP BY 1""")
def hrg_chain_rules(spark, sf_dir):
    """How often the rules of each symbol are used in the grammar of all orders as paths: a bag for each pair of neighbours."""
    rules = hrg.learn(hrg.kinds(_paths(views.order_kinds(spark, sf_dir))))
    return rules.groupBy("symbol").agg(F.sum("count").alias("count"))


@query(f"WITH {ORDERS} SELECT DISTINCT g AS graph_id, true AS member FROM n")
def hrg_round_trip(spark, sf_dir):
    """Every order graph, with its triangles, is derived by the grammar that all of them teach."""
    return _of_orders(spark, sf_dir, _terminals, lambda known: hrg.grammar_of(hrg.learn(known)))


@query()
def generate_graphs(spark, sf_dir):
    """As many graphs that differ as the table has nations, drawn from the grammar of all order graphs by how often its rules are used."""
    grammar = hrg.grammar_of(hrg.learn(hrg.kinds(views.order_kinds(spark, sf_dir))))
    return hrg.generate(spark, grammar, views.table(spark, sf_dir, "nation").count()).select("form", "row", F.size("used").cast("long").alias("n_rules"))
