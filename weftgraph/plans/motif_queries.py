"""Queries of motif mining and of compatible realisations."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from weftgraph.operators import cliques, instructions, matching, mining
from weftgraph.plans.registry import ORDERS, query
from weftgraph.sources import views


def _mined_sql(most: int, least: int) -> str:
    """Motifs of 2 to most nodes: connected sets by joins, codes as the least string over all orders that sort the labels."""
    sets = ["s1 AS (SELECT g, [i] AS s FROM n)"]
    for k in range(2, most + 1):
        sets.append(f"s{k} AS (SELECT DISTINCT s.g, list_sort(list_append(s.s, adj.b)) AS s FROM (SELECT g, s, unnest(s) AS a FROM s{k - 1}) s JOIN adj ON adj.g = s.g AND adj.a = s.a WHERE NOT list_contains(s.s, adj.b))")
    orders = ", ".join(f"({k}, {list(p)})" for k in range(2, most + 1) for p in permutations(range(1, k + 1)))
    every = " UNION ALL ".join(f"SELECT {k} AS k, g, s FROM s{k}" for k in range(2, most + 1))
    return f"""WITH {ORDERS}, adj AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT g, dst, src FROM e), {", ".join(sets)},
every AS (SELECT row_number() OVER () AS id, * FROM ({every})),
labs AS (SELECT id, list(lab ORDER BY p) AS labs FROM (SELECT id, g, unnest(s) AS i, unnest(range(1, k + 1)) AS p FROM every) x JOIN n USING (g, i) GROUP BY 1),
inside AS (SELECT id, list([list_position(s, src), list_position(s, dst)]) AS es FROM every JOIN e ON e.g = every.g AND list_contains(s, src) AND list_contains(s, dst) GROUP BY 1),
perm(k, p) AS (VALUES {orders}),
coded AS (SELECT id, k, g, len(es) AS m, array_to_string(list_sort(labs), ';') || '/' || min(array_to_string(list_sort(list_transform(es, lambda x: (list_position(p, x[1]) - 1) || '>' || (list_position(p, x[2]) - 1) || ':black')), ';')) AS code
  FROM every JOIN labs USING (id) JOIN inside USING (id) JOIN perm USING (k) WHERE list_transform(p, lambda i: labs[i]) = list_sort(labs) GROUP BY id, k, g, es, labs)
SELECT code, CAST(k AS BIGINT) AS n_nodes, CAST(m AS BIGINT) AS n_edges, count(*) AS n_matches, count(DISTINCT g) AS n_graphs, CAST(count(DISTINCT g) * (k - 1 + m) - (k + m) AS BIGINT) AS gain
FROM coded GROUP BY code, k, m HAVING count(DISTINCT g) >= {least}"""


@query(_mined_sql(4, 5))
def mined_motifs(spark, sf_dir):
    return mining.mine(views.order_graphs(spark, sf_dir), most=4, least=5).drop("graph_id", "nodes")


@query(_mined_sql(3, 2).replace("SELECT code, CAST(k", "SELECT * FROM (SELECT code, CAST(k") + ") ORDER BY gain DESC, code LIMIT 10")
def top_motifs(spark, sf_dir):
    """The ten motifs that compress the collection most: a top-k report."""
    return mining.top(mining.mine(views.order_graphs(spark, sf_dir), most=3, least=2), 10).select("code", F.col("n_nodes"), "n_edges", "n_matches", "n_graphs", "gain")


@query(f"""WITH RECURSIVE {ORDERS}, adj AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT g, dst, src FROM e),
m AS (SELECT g, src, dst, row_number() OVER (PARTITION BY g ORDER BY md5(g || ':' || src || ':' || dst), src, dst) AS r FROM e),
near AS (SELECT m.g, r, list(DISTINCT b) AS reach FROM m JOIN adj ON adj.g = m.g AND (adj.a = m.src OR adj.a = m.dst) GROUP BY 1, 2),
rec(g, r, src, dst, ok, blocked) AS (
  SELECT g, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS BIGINT[]) FROM m WHERE r = 1
  UNION ALL
  SELECT m.g, m.r, m.src, m.dst, NOT list_has_any([m.src, m.dst], rec.blocked), CASE WHEN list_has_any([m.src, m.dst], rec.blocked) THEN rec.blocked ELSE list_concat(rec.blocked, near.reach, [m.src, m.dst]) END
  FROM rec JOIN m ON m.g = rec.g AND m.r = rec.r + 1 JOIN near ON near.g = m.g AND near.r = m.r)
SELECT g AS graph_id, src, dst FROM rec WHERE ok""")
def disjoint_matches(spark, sf_dir):
    """Matches that can be replaced at once: a maximal set of edges of each order graph that don't touch."""
    g = views.order_graphs(spark, sf_dir)
    isms = g.edges.select("graph_id", (F.col("src") * 1000 + F.col("dst")).alias("ism_id"), F.array("src", "dst").alias("nodes"))
    none = F.array().cast("array<string>")
    free = isms.select("graph_id", "ism_id", F.lit(0).alias("dir_id"), none.alias("ins"), none.alias("outs"))
    src, dst = F.floor(F.col("ism_id") / 1000), F.col("ism_id") % 1000
    order = F.struct(F.md5(F.concat_ws(":", "graph_id", src, dst)).alias("h"), "graph_id", "ism_id", "dir_id")
    chosen = cliques.compatible(free, isms, g, linear=False, priority=order)
    return chosen.select("graph_id", src.alias("src"), dst.alias("dst"))


@query()
def compatible_realisations(spark, sf_dir):
    """A maximal set of realisations of one edge A to N, one in each order graph at most, that one rule can serve."""
    g = views.order_graphs(spark, sf_dir)
    pairs = matching.match(g, matching.Pattern(("A", "N"), ((0, 1, None),)))
    isms = pairs.select("graph_id", (F.col("n0") * 1000 + F.col("n1")).alias("ism_id"), F.array("n0", "n1").alias("nodes"))
    return cliques.best(instructions.realisations(g, isms, 2), isms, g, tries=2).select("graph_id", "ism_id", "dir_id", "ins", "outs")
