"""Queries of incremental closures, neighbourhoods and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import ego, incremental, shapes, traversal
from weftgraph.plans.registry import ORDERS, query
from weftgraph.sources import views


@query("""WITH RECURSIVE n AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS g, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT a.g, a.i AS src, b.i AS dst FROM n a JOIN n b ON a.g = b.g AND b.i = a.i + 1 WHERE NOT (a.g % 2 = 0 AND 2 IN (a.i, b.i)) UNION SELECT a.g, a.i, b.i FROM n a JOIN n b ON a.g = b.g AND a.i = 1 AND b.i = 3 WHERE a.g % 2 = 0),
r(g, src, dst) AS (SELECT * FROM l UNION SELECT r.g, r.src, l.dst FROM r JOIN l ON r.g = l.g AND l.src = r.dst) SELECT g AS graph_id, src, dst FROM r""")
def closure_maintained(spark, sf_dir):
    """The closure of events by user and day, after the second event of some went and the first and third were joined."""
    g = views.event_graphs(spark, sf_dir)
    pair = g.edges.select("graph_id", "src", "dst")
    gone = pair.where("graph_id % 2 = 0 AND (src = 2 OR dst = 2)")
    added = g.nodes.where("graph_id % 2 = 0 AND node_id = 3").select("graph_id", F.lit(1).alias("src"), F.col("node_id").alias("dst"))
    edges = pair.join(gone, ["graph_id", "src", "dst"], "left_anti").unionByName(added)
    return incremental.maintained(traversal.closure(g.edges), edges, added, gone)


def _ego_sql(radius: int) -> str:
    hops = ["m0 AS (SELECT g, i AS ego, i FROM n)"]
    for k in range(1, radius + 1):
        hops.append(f"m{k} AS (SELECT * FROM m{k - 1} UNION SELECT m.g, m.ego, adj.b FROM m{k - 1} m JOIN adj ON adj.g = m.g AND adj.a = m.i)")
    return f"""WITH {ORDERS}, adj AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT g, dst, src FROM e), {", ".join(hops)},
link AS (SELECT m.g, m.ego, m.i, adj.b AS t FROM m{radius} m JOIN adj ON adj.g = m.g AND adj.a = m.i JOIN m{radius} o ON o.g = m.g AND o.ego = m.ego AND o.i = adj.b),
h0 AS (SELECT m.g, m.ego, m.i, CAST(count(link.t) AS VARCHAR) AS h FROM m{radius} m LEFT JOIN link USING (g, ego, i) GROUP BY 1, 2, 3),
h1 AS (SELECT h0.g, h0.ego, h0.i, md5(h0.h || '|' || coalesce(string_agg(o.h, ',' ORDER BY o.h), '')) AS h FROM h0 LEFT JOIN link USING (g, ego, i) LEFT JOIN h0 o ON o.g = h0.g AND o.ego = h0.ego AND o.i = link.t GROUP BY h0.g, h0.ego, h0.i, h0.h),
h2 AS (SELECT h1.g, h1.ego, h1.i, md5(h1.h || '|' || coalesce(string_agg(o.h, ',' ORDER BY o.h), '')) AS h FROM h1 LEFT JOIN link USING (g, ego, i) LEFT JOIN h1 o ON o.g = h1.g AND o.ego = h1.ego AND o.i = link.t GROUP BY h1.g, h1.ego, h1.i, h1.h),
kind AS (SELECT g, ego, md5(string_agg(h, ',' ORDER BY h)) AS h FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2),
least AS (SELECT g, h, row_number() OVER (PARTITION BY g ORDER BY min(ego)) - 1 AS k FROM kind GROUP BY 1, 2)
SELECT g AS graph_id, ego AS node_id, CAST(k AS VARCHAR) AS label FROM kind JOIN least USING (g, h)"""


@query(_ego_sql(1))
def ego_labels_one_hop(spark, sf_dir):
    return ego.relabelled(views.order_graphs(spark, sf_dir), 1).nodes


@query(_ego_sql(2))
def ego_labels_two_hops(spark, sf_dir):
    return ego.relabelled(views.order_graphs(spark, sf_dir), 2).nodes


@query(f"WITH {ORDERS} SELECT n.g AS graph_id, CAST(count(e.src) AS BIGINT) AS n_edges, CAST(count(e.src) AS BIGINT) AS n_mapped FROM n LEFT JOIN e ON e.g = n.g AND e.src = n.i GROUP BY 1")
def aligned_edges(spark, sf_dir):
    """Each order graph laid on the first one of its form: how many edges it has, and how many of them fall on edges there. Graphs of one shape are laid alike."""
    s = shapes.shaped(views.order_graphs(spark, sf_dir))
    at = traversal.aligned(traversal.canonical_places(s.g))
    one = at.select("graph_id", F.col("node_id").alias("src"), "first", F.col("image").alias("s"))
    two = at.select("graph_id", F.col("node_id").alias("dst"), F.col("image").alias("d"))
    there = s.g.edges.select(F.col("graph_id").alias("first"), F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(1).alias("hit")).distinct()
    laid = s.g.edges.join(one, ["graph_id", "src"]).join(two, ["graph_id", "dst"]).join(there, ["first", "s", "d"], "left")
    per = laid.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count("hit").alias("n_mapped"))
    return s.rows(s.firsts.select("graph_id").join(per, "graph_id", "left").fillna(0)).select("graph_id", "n_edges", "n_mapped")
