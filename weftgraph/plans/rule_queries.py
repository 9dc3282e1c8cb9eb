"""Queries over rules, learning and derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import identifiers
from weftgraph.operators import instructions, matching, primitives, rewriting, rules, traversal
from weftgraph.plans import embedded
from weftgraph.plans.registry import ORDERS, query
from weftgraph.sources import views

#: Rules from parts: those with an even key are known, the others are asked for or added.
PARTS = """r AS (SELECT row_number() OVER (ORDER BY p_brand, p_type) - 1 AS rule_id, p_brand AS symbol, p_type AS form, list_sort(list(DISTINCT p_size % 3)) AS embedding, list_sort(list(DISTINCT p_size % 2)) AS upper FROM part WHERE p_partkey % 2 = 0 GROUP BY 2, 3),
a AS (SELECT p_partkey AS ord, p_brand AS symbol, p_type AS form, [p_size % 3] AS embedding, [p_size % 2] AS upper FROM part WHERE p_partkey % 2 = 1),
k AS (SELECT form, embedding, upper, min(rule_id) AS rule_id FROM r GROUP BY 1, 2, 3)"""


def _rules(spark, sf_dir):
    from pyspark.sql import Window as W

    p = views.table(spark, sf_dir, "part")
    own = p.where("p_partkey % 2 = 0").groupBy("p_brand", "p_type").agg(F.collect_set(F.col("p_size") % 3).alias("embedding"), F.collect_set(F.col("p_size") % 2).alias("upper"))
    nth = F.row_number().over(W.orderBy("p_brand", "p_type")) - 1  # brands x types
    known = own.select(nth.cast("long").alias("rule_id"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("form"), "embedding", "upper")
    new = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("form"), F.array(F.col("p_size") % 3).alias("embedding"), F.array(F.col("p_size") % 2).alias("upper"))
    return known, new


@query(f"WITH {PARTS} SELECT ord AS ask_id, CAST(k.rule_id AS BIGINT) AS rule_id FROM a LEFT JOIN k ON k.form = a.form AND k.embedding = a.embedding AND k.upper = a.upper")
def rule_lookup(spark, sf_dir):
    known, new = _rules(spark, sf_dir)
    return rules.lookup(known, new.withColumnRenamed("ord", "ask_id"))


@query(f"""WITH {PARTS}, f AS (SELECT form, embedding, upper, min(ord) AS ord, min_by(symbol, ord) AS symbol FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.form = a.form AND k.embedding = a.embedding AND k.upper = a.upper) GROUP BY 1, 2, 3)
SELECT CAST(rule_id AS BIGINT) AS rule_id, symbol, form FROM r UNION ALL SELECT CAST((SELECT max(rule_id) FROM r) + row_number() OVER (ORDER BY ord) AS BIGINT), symbol, form FROM f""")
def rule_insert(spark, sf_dir):
    return rules.inserted(*_rules(spark, sf_dir)).select("rule_id", "symbol", "form")


@query(f"""WITH {ORDERS}, two AS (SELECT g FROM n GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT g, i, CASE WHEN i = 1 AND g % 2 = 0 AND g IN (SELECT g FROM two) THEN 'gray' ELSE lab END AS lab FROM n WHERE NOT (i = 2 AND g % 2 = 0)),
d AS (SELECT DISTINCT g, CASE WHEN src = 2 AND g % 2 = 0 THEN 1 ELSE src END AS src, CASE WHEN dst = 2 AND g % 2 = 0 THEN 1 ELSE dst END AS dst FROM e WHERE NOT (g % 2 = 0 AND src IN (1, 2) AND dst IN (1, 2)))
SELECT a.lab AS n0_label, b.lab AS n1_label, count(*) AS n_matches FROM d JOIN c a ON a.g = d.g AND a.i = d.src JOIN c b ON b.g = d.g AND b.i = d.dst GROUP BY 1, 2""")
def rematch_changed(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    pair = matching.Pattern((None, None), ((0, 1, None),))
    isms = g.nodes.where("node_id <= 2 AND graph_id % 2 = 0").groupBy("graph_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes")).where("size(nodes) = 2").withColumn("ism_id", F.lit(0))
    new = rewriting.contract(g, isms, "gray")
    return rules.rematch(matching.match(g, pair), new, isms, pair).groupBy("n0_label", "n1_label").agg(F.count("*").alias("n_matches"))


@query("""WITH RECURSIVE n AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS g, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT a.g, a.i AS src, b.i AS dst FROM n a JOIN n b ON a.g = b.g AND b.i = a.i + 1 WHERE NOT (a.g % 2 = 0 AND 2 IN (a.i, b.i))),
r(g, src, dst) AS (SELECT * FROM l UNION SELECT r.g, r.src, l.dst FROM r JOIN l ON r.g = l.g AND l.src = r.dst) SELECT g AS graph_id, src, dst FROM r""")
def closure_changed(spark, sf_dir):
    g = views.event_graphs(spark, sf_dir)
    gone = g.nodes.where("node_id = 2 AND graph_id % 2 = 0").select("graph_id", "node_id")
    return rules.reclosed(traversal.closure(g.edges), primitives.without(g, gone).edges, gone)


@query("""WITH c AS (SELECT l_orderkey AS g, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT g AS graph_id, k AS level, n - 1 AS n_edges FROM c, (VALUES (CAST(1 AS BIGINT)), (2)) v(k)""")
def parse_graphs(spark, sf_dir):
    """The parse graphs of the orders' chains: edges inside right-hand sides, and from nonterminals to what replaced them."""
    from weftgraph.plans.queries import _flag_rules, _flag_sequences

    table = [(k, list(r.labels), [{"a": a, "b": b, "x": x} for a, b, x in r.edges]) for k, r in enumerate(_flag_rules())]
    rhs = spark.createDataFrame(table, "rule_id int, labels array<string>, edges array<struct<a:int,b:int,x:string>>")
    steps = _flag_sequences(spark, sf_dir).select(F.col("seq_id").alias("graph_id"), F.posexplode("rules").alias("seq", "rule_id"))
    return rules.parse_graph(steps, rhs)[1].groupBy("graph_id", "level").agg(F.count("*").alias("n_edges"))


@query(f"""WITH {ORDERS}, s AS (SELECT g, src * 1000 + dst AS m, src, dst FROM e WHERE sl = 'A' AND dl = 'N'), p AS (SELECT g, m, src AS i, 'A' AS x, src, dst FROM s UNION ALL SELECT g, m, dst, 'N', src, dst FROM s),
u AS (SELECT g, src AS a, dst AS b, dl AS mu FROM e UNION SELECT g, dst, src, sl FROM e), y AS (SELECT DISTINCT p.g, p.m, u.b AS y, u.mu FROM p JOIN u ON u.g = p.g AND u.a = p.i WHERE u.b NOT IN (p.src, p.dst))
SELECT x, mu, needed, count(*) AS n_isms FROM (SELECT DISTINCT y.g, y.m, p.x, y.mu, EXISTS (SELECT 1 FROM u WHERE u.g = y.g AND u.a = p.i AND u.b = y.y) AS needed FROM y JOIN p ON p.g = y.g AND p.m = y.m) GROUP BY 1, 2, 3""")
def plain_insets(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    m = matching.match(g, matching.Pattern(("A", "N"), ((0, 1, None),)))
    isms = m.select("graph_id", (F.col("n0") * 1000 + F.col("n1")).alias("ism_id"), F.array("n0", "n1").alias("nodes"))
    return rules.plain_instructions(instructions.surroundings(g, isms), isms, g).groupBy("x", "mu", "needed").agg(F.count("*").alias("n_isms"))


@query(f"""WITH {ORDERS} SELECT e.g AS graph_id, (src - 1) // 3 AS part, count(*) AS n_edges FROM e WHERE (src - 1) // 3 = (dst - 1) // 3 GROUP BY 1, 2""")
def motif_groups(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    parts = rules.split_into(g, g.nodes.select("graph_id", F.floor((F.col("node_id") - 1) / 3).alias("group"), "node_id"))
    return parts.edges.groupBy(F.col("graph_id.graph_id").alias("graph_id"), F.col("graph_id.group").alias("part")).agg(F.count("*").alias("n_edges"))


@query("SELECT conv_id AS graph_id, count(*) AS n_nodes, count(*) - 1 AS n_edges, true AS same FROM conversations GROUP BY 1")
def learn_round_trip(spark, sf_dir):
    return embedded.round_trip(views.conversation_graphs(spark, sf_dir)).select("graph_id", "n_nodes", "n_edges", "same")


@query("SELECT min(g) AS graph_id, count(*) AS n_graphs FROM (SELECT conv_id AS g, string_agg(role, ',' ORDER BY turn) AS form FROM conversations GROUP BY 1) GROUP BY form")
def non_isomorphic_graphs(spark, sf_dir):
    """Chains are isomorphic if their labels are the same in order."""
    forms = traversal.canonical_forms(views.conversation_graphs(spark, sf_dir))
    first = matching.first_of_each(forms, ["form"], "graph_id")
    return first.join(forms.groupBy("form").agg(F.count("*").alias("n_graphs")), "form").select("graph_id", "n_graphs")


@query(f"""WITH {ORDERS} SELECT CAST(0 AS BIGINT) AS part, count(*) AS n_nodes, count(DISTINCT g) AS n_graphs FROM n UNION ALL SELECT 1, count(*), count(DISTINCT conv_id) FROM conversations""")
def union_graphs(spark, sf_dir):
    g = views.union([views.order_graphs(spark, sf_dir), views.conversation_graphs(spark, sf_dir)])
    return g.nodes.groupBy(F.col("graph_id.part").alias("part")).agg(F.count("*").alias("n_nodes"), F.countDistinct("graph_id.id").alias("n_graphs"))


@query(f"""WITH {ORDERS}, l AS (SELECT g, max(i) AS last FROM n GROUP BY 1) SELECT n.g AS graph_id, n.i AS ord, CAST(last + row_number() OVER (PARTITION BY n.g ORDER BY n.i) AS BIGINT) AS node_id FROM n JOIN l ON l.g = n.g WHERE lab = 'R'""")
def next_ids(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return identifiers.next_ids(g.nodes, g.nodes.where("label = 'R'").select("graph_id", F.col("node_id").alias("ord")))


@query("""WITH b AS (SELECT l_orderkey AS mol, l_linenumber AS bond, [l_suppkey % 5, l_partkey % 5 + 5] AS atoms, l_linenumber % 2 AS ring FROM lineitem)
SELECT DISTINCT x.mol, CAST(x.bond AS BIGINT) AS a, CAST(y.bond AS BIGINT) AS b FROM b x JOIN b y ON x.mol = y.mol AND x.bond < y.bond AND (x.ring = y.ring OR list_has_any(x.atoms, y.atoms))""")
def clique_graph(spark, sf_dir):
    b = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("bond"), F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5 + 5).alias("atoms"))
    return primitives.clique_graph(b, b.select("mol", (F.col("bond") % 2).alias("ring"), "bond"))
