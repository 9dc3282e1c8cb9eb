"""Registered queries over the driver's tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import identifiers, tokens
from weftgraph.operators import components, hypergraphs, instructions, matching, metrics, primitives, productions, rewriting, tournaments, traversal
from weftgraph.plans import fixtures, learning
from weftgraph.plans.registry import NONTERMINALS, ORDERS, QUERIES, SQL, query
from weftgraph.sources import files, views

PATH3 = matching.Pattern((None, None, None), ((0, 1, None), (1, 2, None)))
TRIANGLE = matching.Pattern((None, None, None), ((0, 1, None), (1, 2, None), (0, 2, None)))
PAIR = matching.Pattern((None, None), ((0, 1, None),))


@query(f"""WITH {ORDERS}
SELECT a.lab AS n0_label, b.lab AS n1_label, c.lab AS n2_label, CAST(count(*) AS BIGINT) AS n_matches, CAST(count(DISTINCT x.g) AS BIGINT) AS n_graphs
FROM e x JOIN e y ON x.g = y.g AND x.dst = y.src JOIN n a ON a.g = x.g AND a.i = x.src JOIN n b ON b.g = x.g AND b.i = x.dst JOIN n c ON c.g = y.g AND c.i = y.dst
WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.g = x.g AND (z.src = x.src AND z.dst = y.dst OR z.src = y.dst AND z.dst = x.src))
GROUP BY 1, 2, 3""")
def motif_path3_induced(spark, sf_dir):
    return matching.support(views.order_graphs(spark, sf_dir), PATH3)


@query(f"""WITH {ORDERS}
SELECT a.lab AS n0_label, b.lab AS n1_label, c.lab AS n2_label, CAST(count(*) AS BIGINT) AS n_matches, CAST(count(DISTINCT x.g) AS BIGINT) AS n_graphs
FROM e x JOIN e y ON x.g = y.g AND x.dst = y.src JOIN e z ON z.g = x.g AND z.src = x.src AND z.dst = y.dst
JOIN n a ON a.g = x.g AND a.i = x.src JOIN n b ON b.g = x.g AND b.i = x.dst JOIN n c ON c.g = y.g AND c.i = y.dst GROUP BY 1, 2, 3""")
def motif_triangle(spark, sf_dir):
    return matching.support(views.order_graphs(spark, sf_dir), TRIANGLE)


@query(f"WITH {ORDERS} SELECT sl AS n0_label, dl AS n1_label, CAST(count(*) AS BIGINT) AS n_matches, CAST(count(DISTINCT g) AS BIGINT) AS n_graphs FROM e GROUP BY 1, 2")
def motif_edge_support(spark, sf_dir):
    return matching.support(views.order_graphs(spark, sf_dir), PAIR)


@query(f"WITH {ORDERS} SELECT lab AS label, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(DISTINCT g) AS BIGINT) AS n_graphs FROM n GROUP BY 1")
def node_label_counts(spark, sf_dir):
    return views.order_graphs(spark, sf_dir).nodes.groupBy("label").agg(F.count("*").alias("n_nodes"), F.countDistinct("graph_id").alias("n_graphs"))


@query(f"WITH {ORDERS} SELECT g AS graph_id, src, dst FROM e WHERE sl <> 'R' AND dl <> 'R'")
def induced_subgraph(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return primitives.induced(g, g.nodes.where("label <> 'R'")).edges.select("graph_id", "src", "dst")


@query(f"""WITH {ORDERS} SELECT DISTINCT g AS graph_id, y AS node_id FROM (SELECT g, dst AS y FROM e WHERE src IN (1, 3) UNION SELECT g, src FROM e WHERE dst IN (1, 3)) WHERE y NOT IN (1, 3)""")
def neighbors(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return primitives.neighbours(g, g.nodes.where("node_id IN (1, 3)"))


@query(f"WITH {ORDERS} SELECT g AS graph_id, i AS node_id, lab AS label FROM n WHERE lab IN ('A', 'R')")
def search_nts(spark, sf_dir):
    return primitives.labelled(views.order_graphs(spark, sf_dir), ["A", "R"])


@query(f"WITH {ORDERS} SELECT g AS graph_id, min(i) AS node_id FROM n WHERE lab = 'A' GROUP BY 1")
def first_node_by_label(spark, sf_dir):
    return primitives.first_by_label(views.order_graphs(spark, sf_dir), "A")


@query(f"WITH {ORDERS} SELECT DISTINCT g AS graph_id FROM e WHERE sl = 'R' AND dl = 'R'")
def boundary_edges(spark, sf_dir):
    return primitives.boundary(views.order_graphs(spark, sf_dir), NONTERMINALS)


@query(f"""WITH {ORDERS}, m AS (SELECT g, CAST(count(*) AS BIGINT) AS n_edges FROM e GROUP BY 1)
SELECT n.g AS graph_id, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(*) FILTER (lab <> 'R') AS BIGINT) AS n_terms, bool_and(lab = 'R') AS all_nonterminal,
count(*) FILTER (lab = 'A') = 1 AND count(*) FILTER (lab = 'N') = 1 AS one_source_and_sink, count(*) FILTER (lab IN ('A', 'N')) = 1 AS source_xor_sink, coalesce(max(m.n_edges), 0) AS n_edges
FROM n LEFT JOIN m ON m.g = n.g GROUP BY n.g""")
def component_stats(spark, sf_dir):
    return primitives.statistics(views.order_graphs(spark, sf_dir), NONTERMINALS, "A", "N")


@query(f"""WITH {ORDERS}, k AS (SELECT DISTINCT g FROM n WHERE lab <> 'R' ORDER BY g LIMIT 500) SELECT g AS graph_id, src, dst FROM e WHERE sl <> 'R' AND dl <> 'R' AND g IN (SELECT g FROM k)""")
def without_ends_capped(spark, sf_dir):
    return primitives.without_ends(views.order_graphs(spark, sf_dir), ["R"], 500).edges.select("graph_id", "src", "dst")


@query(f"""WITH {ORDERS}, b AS (SELECT g, i, (i - 1) // 4 AS block FROM n),
h AS (SELECT e.g, a.block, e.dst AS i FROM e JOIN b a ON a.g = e.g AND a.i = e.src JOIN b c ON c.g = e.g AND c.i = e.dst WHERE a.block <> c.block
      UNION SELECT e.g, c.block, e.src FROM e JOIN b a ON a.g = e.g AND a.i = e.src JOIN b c ON c.g = e.g AND c.i = e.dst WHERE a.block <> c.block)
SELECT g AS graph_id, CAST(block AS BIGINT) AS block, i AS node_id, false AS halo FROM b UNION ALL SELECT g, CAST(block AS BIGINT), i, true FROM h""")
def partition_blocks(spark, sf_dir):
    return primitives.partition(views.order_graphs(spark, sf_dir), 4)[0]


@query(f"WITH {ORDERS} SELECT g AS graph_id, src, dst FROM e WHERE src <> 2 AND dst <> 2")
def remove_nodes(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return primitives.without(g, g.nodes.where("node_id = 2")).edges.select("graph_id", "src", "dst")


@query(f"""WITH {ORDERS}, m AS (SELECT g, src AS a, dst AS b FROM e UNION ALL SELECT g, dst, src FROM e)
SELECT g AS graph_id, CAST(least(a, b) AS BIGINT) AS low, CAST(greatest(a, b) AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS n_mappings FROM m GROUP BY 1, 2, 3""")
def automorphism_dedupe(spark, sf_dir):
    p = matching.Pattern((None, None), ((0, 1, None),), directed=False)
    sets = matching.node_sets(matching.match(views.order_graphs(spark, sf_dir), p), p.columns)
    return sets.select("graph_id", F.element_at("nodes", 1).alias("low"), F.element_at("nodes", 2).alias("high"), "n_mappings")


@query(f"WITH {ORDERS} SELECT g AS graph_id, src AS n0, dst AS n1 FROM e WHERE sl = 'A' AND dl = 'A' AND g NOT IN (SELECT g FROM n WHERE lab = 'R')")
def linear_filter(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return matching.linear(matching.match(g, matching.Pattern(("A", "A"), ((0, 1, None),))), g, NONTERMINALS).select("graph_id", "n0", "n1")


@query(f"WITH {ORDERS} SELECT DISTINCT o.o_orderkey AS graph_id, o_orderpriority FROM orders o SEMI JOIN (SELECT x.g FROM e x JOIN e y ON x.g = y.g AND x.dst = y.src WHERE x.sl = 'N' AND x.dl = 'N' AND y.dl = 'N') m ON m.g = o.o_orderkey")
def find_partial(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    hit = matching.containing(g, matching.Pattern(("N", "N", "N"), ((0, 1, None), (1, 2, None))), induced=False)
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), "o_orderpriority").join(hit, "graph_id", "left_semi").distinct()


@query(f"""WITH {ORDERS}, s AS (SELECT g, src, dst FROM e WHERE sl = 'A' AND dl = 'N'),
near AS (SELECT g, src, dst, src AS x FROM s UNION SELECT g, src, dst, dst FROM s UNION SELECT s.g, s.src, s.dst, e.dst FROM s JOIN e ON e.g = s.g AND e.src IN (s.src, s.dst))
SELECT DISTINCT a.g AS graph_id, least(a.src * 1000 + a.dst, b.src * 1000 + b.dst) AS a, greatest(a.src * 1000 + a.dst, b.src * 1000 + b.dst) AS b
FROM near a JOIN s b ON a.g = b.g AND (a.x = b.src OR a.x = b.dst) WHERE a.src * 1000 + a.dst <> b.src * 1000 + b.dst""")
def touching_matches(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    m = matching.match(g, matching.Pattern(("A", "N"), ((0, 1, None),)))
    return matching.touching(m.select("graph_id", (F.col("n0") * 1000 + F.col("n1")).alias("ism_id"), F.array("n0", "n1").alias("nodes")), g)


def _matches(g):
    m = matching.match(g, matching.Pattern(("A", "N"), ((0, 1, None),)))
    return m.select("graph_id", (F.col("n0") * 1000 + F.col("n1")).alias("ism_id"), F.array("n0", "n1").alias("nodes"))


#: Matches A -> N and their surroundings in SQL.
AROUND = f"""{ORDERS}, s AS (SELECT g, src * 1000 + dst AS m, src, dst FROM e WHERE sl = 'A' AND dl = 'N'),
p AS (SELECT g, m, src, dst, 0 AS pos, src AS x FROM s UNION ALL SELECT g, m, src, dst, 1, dst FROM s),
r AS (SELECT p.g, p.m, e.dst AS y, e.dl AS mu, p.pos, 'out' AS d FROM p JOIN e ON e.g = p.g AND e.src = p.x WHERE e.dst NOT IN (p.src, p.dst)
      UNION ALL SELECT p.g, p.m, e.src, e.sl, p.pos, 'in' FROM p JOIN e ON e.g = p.g AND e.dst = p.x WHERE e.src NOT IN (p.src, p.dst))"""


@query(f"""WITH {AROUND}, c AS (SELECT g, m, y, mu, string_agg(pos || ':' || d || ':black', ',' ORDER BY pos || ':' || d || ':black') AS signature FROM r GROUP BY 1, 2, 3, 4)
SELECT g AS graph_id, m AS ism_id, y, mu, signature, CAST(dense_rank() OVER (PARTITION BY g, m ORDER BY mu, signature) AS BIGINT) AS class FROM c""")
def equiv_class(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return instructions.classes(instructions.surroundings(g, _matches(g)))


@query(f"WITH {AROUND} SELECT mu, CAST(pos AS BIGINT) AS pos, d, CAST(count(DISTINCT (g, m)) AS BIGINT) AS n_isms FROM r GROUP BY 1, 2, 3")
def inset(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return instructions.inset(instructions.surroundings(g, _matches(g))).groupBy("mu", "pos", "d").agg(F.count("*").alias("n_isms"))


@query(f"""WITH {AROUND}, q AS (SELECT DISTINCT g, m, y, mu FROM r), a AS (SELECT q.*, pos, d FROM q, (VALUES (0), (1)) AS t(pos), (VALUES ('in'), ('out')) AS u(d))
SELECT mu, CAST(pos AS BIGINT) AS pos, d, CAST(count(DISTINCT (g, m)) AS BIGINT) AS n_isms FROM a
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.g = a.g AND r.m = a.m AND r.y = a.y AND r.pos = a.pos AND r.d = a.d) GROUP BY 1, 2, 3""")
def outset(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return instructions.outset(instructions.surroundings(g, _matches(g)), 2).groupBy("mu", "pos", "d").agg(F.count("*").alias("n_isms"))


#: Realisations of the matches in SQL: a direction for each class of neighbours, without those whose ins and outs meet.
REALISED = f"""{AROUND}, c AS (SELECT g, m, y, mu, string_agg(pos || ':' || d || ':black', ',' ORDER BY pos || ':' || d || ':black') AS signature FROM r GROUP BY 1, 2, 3, 4),
k AS (SELECT g, m, y, mu, dense_rank() OVER (PARTITION BY g, m ORDER BY mu, signature) AS class FROM c),
w AS (SELECT s.g, s.m, coalesce(max(class), 0) AS n FROM s LEFT JOIN k ON k.g = s.g AND k.m = s.m GROUP BY 1, 2),
pick AS (SELECT g, m, unnest(range(0, CAST(1 << n AS BIGINT))) AS dir FROM w),
h AS (SELECT k.*, dir, CASE WHEN (dir >> (class - 1)) & 1 = 1 THEN 'in' ELSE 'out' END AS new FROM k JOIN pick ON pick.g = k.g AND pick.m = k.m),
i AS (SELECT h.g, h.m, dir, list(DISTINCT h.mu || '|black|black|' || pos || '|' || new || '|' || d) AS ins FROM h JOIN r ON r.g = h.g AND r.m = h.m AND r.y = h.y GROUP BY 1, 2, 3),
o AS (SELECT h.g, h.m, dir, list(DISTINCT h.mu || '|black|black|' || p.pos || '|' || new || '|' || u.d) AS outs FROM h, (VALUES (0), (1)) AS p(pos), (VALUES ('in'), ('out')) AS u(d)
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.g = h.g AND r.m = h.m AND r.y = h.y AND r.pos = p.pos AND r.d = u.d) GROUP BY 1, 2, 3),
real AS (SELECT pick.g, pick.m, pick.dir, list_sort(coalesce(ins, [])) AS ins, list_sort(coalesce(outs, [])) AS outs FROM pick LEFT JOIN i ON i.g = pick.g AND i.m = pick.m AND i.dir = pick.dir
         LEFT JOIN o ON o.g = pick.g AND o.m = pick.m AND o.dir = pick.dir WHERE NOT list_has_any(coalesce(ins, []), coalesce(outs, [])))"""


@query(f"WITH {REALISED} SELECT array_to_string(ins, ' ') AS ins, array_to_string(outs, ' ') AS outs, CAST(count(DISTINCT g) AS BIGINT) AS n_graphs, count(*) AS n_isms FROM real GROUP BY ins, outs")
def realisations(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    sig = instructions.signatures(instructions.realisations(g, _matches(g), 2))
    return sig.select(F.array_join("sig_ins", " ").alias("ins"), F.array_join("sig_outs", " ").alias("outs"), "n_graphs", "n_isms")


@query(f"""WITH {REALISED}, t AS (SELECT DISTINCT md5(array_to_string(ins, ' ') || '/' || array_to_string(outs, ' ')) AS sig, ins, outs FROM real),
bad AS (SELECT DISTINCT least(a.sig, b.sig) AS a, greatest(a.sig, b.sig) AS b FROM t a JOIN t b ON list_has_any(a.ins, b.outs)) SELECT a, count(*) AS n_conflicts FROM bad GROUP BY 1""")
def signature_compat(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    sig = instructions.signatures(instructions.realisations(g, _matches(g), 2))
    named = sig.select(F.md5(F.concat_ws("/", F.array_join("sig_ins", " "), F.array_join("sig_outs", " "))).alias("sig"), F.col("sig_ins").alias("ins"), F.col("sig_outs").alias("outs"))
    bad = instructions.conflicts(named)
    return bad.groupBy("a").agg(F.count("*").alias("n_conflicts"))


@query(f"""WITH {REALISED}, f AS (SELECT *, row_number() OVER (PARTITION BY g, m ORDER BY dir) AS nth FROM real), l AS (SELECT DISTINCT unnest(ins) AS x FROM f WHERE nth = 1), u AS (SELECT DISTINCT unnest(outs) AS x FROM f WHERE nth = 1)
SELECT 'A>N' AS motif, (SELECT string_agg(x, ' ' ORDER BY x) FROM l) AS lower, (SELECT string_agg(x, ' ' ORDER BY x) FROM u) AS outs""")
def instruction_bounds(spark, sf_dir):
    """What the first realisation of each match needs and forbids; of one match a rule serves one realisation."""
    g = views.order_graphs(spark, sf_dir)
    r = instructions.first_of_match(instructions.realisations(g, _matches(g), 2)).withColumn("motif", F.lit("A>N"))
    b = instructions.bounds(r, ["motif"])
    return b.select("motif", F.array_join("lower", " ").alias("lower"), F.array_join("outs", " ").alias("outs"))


#: A rule's embedding: the chain goes on before the first node and after the second.
CHAIN = [f"{mu}|black|black|{p}|{d}|{e}" for mu in "ANR" for p, d, e in ((0, "in", "in"), (1, "out", "out"))]


@query(f"""WITH {REALISED}, f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m, dir) AS nth FROM real WHERE list_has_all({CHAIN}, ins) AND NOT list_has_any({CHAIN}, outs))
SELECT g AS graph_id, m AS ism_id, dir AS dir_id FROM f WHERE nth = 1""")
def compress_one_per_graph(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    r = instructions.realisations(g, _matches(g), 2)
    return rewriting.one_per_graph(instructions.admitted(r, CHAIN)).select("graph_id", "ism_id", "dir_id")


@query(f"""WITH {ORDERS}, k AS (SELECT sl || '>' || dl AS motif, count(DISTINCT g) AS c FROM e GROUP BY 1)
SELECT motif, CAST(c AS BIGINT) AS n_graphs, CAST(2 * c AS BIGINT) AS score FROM k ORDER BY c DESC, motif LIMIT 1""")
def find_embedding_top1(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    e = primitives.with_labels(g).groupBy(F.concat("src_label", F.lit(">"), "dst_label").alias("motif")).agg(F.countDistinct("graph_id").alias("n_graphs"))
    return e.withColumn("score", 2 * F.col("n_graphs")).orderBy(F.desc("score"), "motif").limit(1)


@query(f"""WITH {ORDERS} SELECT DISTINCT g AS graph_id, CASE WHEN src = 2 THEN 1 ELSE src END AS src, CASE WHEN dst = 2 THEN 1 ELSE dst END AS dst FROM e
WHERE NOT (src IN (1, 2) AND dst IN (1, 2))""")
def contract_edges(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    isms = g.nodes.where("node_id <= 2").groupBy("graph_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes")).where("size(nodes) = 2").withColumn("ism_id", F.lit(0))
    return rewriting.contract(g, isms, "gray").edges.select("graph_id", "src", "dst")


@query(f"""WITH {ORDERS}, l AS (SELECT g, max(i) AS m FROM n GROUP BY 1)
SELECT e.g AS graph_id, src, dst FROM e WHERE src <> 1 AND dst <> 1
UNION SELECT g, m + 1, m + 2 FROM l
UNION SELECT e.g, l.m + 2, e.dst FROM e JOIN l ON l.g = e.g WHERE e.src = 1 AND e.dl <> 'R'
UNION SELECT e.g, e.dst, l.m + 1 FROM e JOIN l ON l.g = e.g WHERE e.src = 1 AND e.dl = 'R'""")
def apply_rule_edges(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    rule = rewriting.Rule("x", ("a", "b"), ((0, 1, "black"),), frozenset({("A", "black", "black", 1, "out", "out"), ("N", "black", "black", 1, "out", "out"), ("R", "black", "black", 0, "out", "in")}))
    return rewriting.apply_once(g, g.nodes.where("node_id = 1").select("graph_id", "node_id"), rule).edges.select("graph_id", "src", "dst")


@query("""WITH RECURSIVE n AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS g, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
r(g, src, dst) AS (SELECT a.g, a.i, b.i FROM n a JOIN n b ON a.g = b.g AND b.i = a.i + 1 UNION SELECT r.g, r.src, b.i FROM r JOIN n b ON r.g = b.g AND b.i = r.dst + 1)
SELECT g AS graph_id, src, dst FROM r""")
def reachability(spark, sf_dir):
    return traversal.closure(views.event_graphs(spark, sf_dir).edges)


@query(f"WITH {ORDERS} SELECT DISTINCT g AS graph_id, true AS is_dag FROM n")
def is_dag(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return traversal.levels(g).groupBy("graph_id").agg(F.every(F.col("level").isNotNull()).alias("is_dag"))


@query(f"""WITH RECURSIVE {ORDERS}, d(g, i, depth) AS (SELECT g, i, 0 FROM n WHERE i = 1 UNION SELECT d.g, e.dst, d.depth + 1 FROM d JOIN e ON e.g = d.g AND e.src = d.i)
SELECT g AS graph_id, i AS node_id, CAST(max(depth) AS BIGINT) AS level, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY 1, 2""")
def levels(spark, sf_dir):
    return traversal.levels(views.order_graphs(spark, sf_dir)).select("graph_id", "node_id", "level", "depth")


@query(f"WITH {ORDERS} SELECT g AS graph_id, CAST(max(i) - 1 AS BIGINT) AS longest FROM n GROUP BY 1")
def longest_path(spark, sf_dir):
    return traversal.levels(views.order_graphs(spark, sf_dir)).groupBy("graph_id").agg(F.max("level").alias("longest"))


@query("""WITH n AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, md5(role) AS h FROM conversations),
a AS (SELECT n.g, n.i, md5(n.h || '|' || coalesce(o.h, '') || '|' || coalesce(p.h, '')) AS h FROM n LEFT JOIN n o ON o.g = n.g AND o.i = n.i + 1 LEFT JOIN n p ON p.g = n.g AND p.i = n.i - 1),
b AS (SELECT a.g, a.i, md5(a.h || '|' || coalesce(o.h, '') || '|' || coalesce(p.h, '')) AS h FROM a LEFT JOIN a o ON o.g = a.g AND o.i = a.i + 1 LEFT JOIN a p ON p.g = a.g AND p.i = a.i - 1)
SELECT g AS graph_id, md5(string_agg(h, ',' ORDER BY h)) AS h FROM b GROUP BY 1""")
def wl_hash(spark, sf_dir):
    return traversal.graph_hash(views.conversation_graphs(spark, sf_dir))


@query("""SELECT count(*) AS n_graphs, min(g) AS first FROM (SELECT l_orderkey AS g, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS form FROM lineitem GROUP BY 1) GROUP BY form""")
def canonical_form(spark, sf_dir):
    """Order graphs by form: a path joins all nodes of one in order, so they are isomorphic if their labels are the same in order."""
    return traversal.canonical_forms(views.order_graphs(spark, sf_dir)).groupBy("form").agg(F.count("*").alias("n_graphs"), F.min("graph_id").alias("first")).drop("form")


@query("""WITH f AS (SELECT conv_id AS g, string_agg(role, ',' ORDER BY turn) AS form FROM conversations GROUP BY 1)
SELECT g AS graph_id, form FROM f WHERE g % 2 = 1 AND form NOT IN (SELECT form FROM f WHERE g % 2 = 0)""")
def novelty_antijoin(spark, sf_dir):
    f = _chains(spark, sf_dir)
    return metrics.novel(f.where("graph_id % 2 = 1"), f.where("graph_id % 2 = 0")).select("graph_id", "form")


def _chains(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return c.groupBy(F.col("conv_id").alias("graph_id")).agg(F.array_join(roles, ",").alias("form"))


@query("""WITH f AS (SELECT conv_id AS g, string_agg(role, ',' ORDER BY turn) AS form FROM conversations GROUP BY 1)
SELECT g AS graph_id, form, count(*) OVER (PARTITION BY form) = 1 AS is_unique FROM f""")
def uniqueness(spark, sf_dir):
    return metrics.uniqueness(_chains(spark, sf_dir)).select("graph_id", "form", "is_unique")


@query("""WITH f AS (SELECT conv_id AS g, string_agg(role, ',' ORDER BY turn) AS form, count(*) <= 6 AS valid FROM conversations GROUP BY 1),
t AS (SELECT * FROM f WHERE g % 2 = 1), u AS (SELECT form, count(*) AS c FROM t WHERE valid GROUP BY 1)
SELECT count(*) AS n, avg(valid::INT) AS valid, (SELECT coalesce(sum(c), 0) FROM u WHERE form NOT IN (SELECT form FROM f WHERE g % 2 = 0)) / count(*) AS novel,
(SELECT count(*) FROM u WHERE c = 1) / count(*) AS "unique" FROM t""")
def evaluate(spark, sf_dir):
    f = _chains(spark, sf_dir).withColumn("valid", F.size(F.split("form", ",")) <= 6)
    return metrics.evaluate(f.where("graph_id % 2 = 1"), f.where("graph_id % 2 = 0"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS rule_id FROM part) SELECT r.rule_id, CAST(count(p.p_partkey) AS BIGINT) AS n_used
FROM r LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p.p_brand = r.rule_id GROUP BY 1""")
def rule_usage_counts(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "rule_id")
    return metrics.rule_usage(p.where("p_size > 25").select("rule_id"), p.select("rule_id").distinct())


@query("""WITH r AS (SELECT p_brand AS symbol, p_type AS form, CAST(sum(p_size) AS BIGINT) AS count FROM part GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY symbol, form) - 1 AS BIGINT) AS rule_id, symbol, form, count FROM r""")
def hrg_merge_counts(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return hypergraphs.merge_rules(p.select((F.col("p_partkey") % 4).alias("grammar_id"), F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("form"), F.col("p_size").alias("count")))


@query("""WITH v AS (SELECT p_brand AS symbol, p_size AS arity FROM part) SELECT symbol FROM v GROUP BY 1 HAVING count(DISTINCT arity) > 1""")
def vocab_conflicts(spark, sf_dir):
    return hypergraphs.arity_conflicts(views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_size").alias("arity")))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.9) AS is_train FROM orders),
s AS (SELECT avg(-o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM o WHERE is_train) SELECT o_orderkey, is_train, round((-o_totalprice - m) / d, 6) AS z FROM o, s""")
def zscore_split(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return metrics.standardised(o, "o_orderkey", "o_totalprice").select("o_orderkey", "is_train", F.round("z", 6).alias("z"))


@query("""SELECT round(sqrt(avg((l_extendedprice - 1000 * l_quantity) ** 2)), 4) AS rmse, round(corr(l_extendedprice, 1000 * l_quantity), 8) AS correlation,
round(1 - sum((l_extendedprice - 1000 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 8) AS r2 FROM lineitem""")
def rmse_corr(spark, sf_dir):
    s = metrics.fit_scores(views.table(spark, sf_dir, "lineitem").withColumn("guess", 1000 * F.col("l_quantity")), "l_extendedprice", "guess")
    return s.select(F.round("rmse", 4).alias("rmse"), F.round("correlation", 8).alias("correlation"), F.round("r2", 8).alias("r2"))


@query("SELECT round(avg(-0.5 * ((l_discount - 0.05) / (0.01 + l_tax)) ** 2 - ln(0.01 + l_tax) - 0.5 * ln(2 * pi())), 6) AS log_likelihood FROM lineitem")
def log_likelihood(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("e"), (0.01 + F.col("l_tax")).alias("s"))
    return metrics.log_likelihood(rows, "e", "s").select(F.round("log_likelihood", 6).alias("log_likelihood"))


@query("""WITH v AS (SELECT label, vec_id, embedding FROM embeddings) SELECT CAST(a.label AS BIGINT) AS label, count(*) AS n_pairs, round(avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_distance
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def pairwise_distance(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings")
    return metrics.mean_distance(v, "label", "vec_id", "embedding").withColumn("mean_distance", F.round("mean_distance", 6))


@query("""WITH p AS (SELECT unnest(range(1, 65)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT k, sum(x) AS s, sum(x * x) AS q FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(n * (n - 1) / 2 AS BIGINT) AS n_pairs, round((n * sum(q) - sum(s * s)) / (n * (n - 1) / 2), 6) AS mean_square_distance FROM s, n GROUP BY n""")
def mean_square_distance(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return metrics.mean_square_distance(v, "v").withColumn("mean_square_distance", F.round("mean_square_distance", 6))


@query("""WITH r AS (SELECT s_nationkey AS item, s_suppkey AS player, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r FROM supplier)
SELECT CAST(item AS BIGINT) AS item, CAST(r // 2 AS BIGINT) AS board, min_by(player, r) AS i, CASE WHEN count(*) = 2 THEN max_by(player, r) END AS j FROM r GROUP BY 1, 2""")
def swiss_round(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("player"), F.col("s_acctbal").alias("score"))
    return tournaments.swiss_round(s)


@query("SELECT CAST(a.s_nationkey AS BIGINT) AS item, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def round_robin(spark, sf_dir):
    return tournaments.round_robin(views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("player")))


@query()
def bradley_terry(spark, sf_dir):
    """For each customer the ratings of its suppliers; those that serve one order meet, and share a game by quantity."""
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("q"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_suppkey").alias("player"), "q"))).alias("x"))
    meet = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["player"] > a["player"]), lambda b: F.struct(a["player"].alias("i"), b["player"].alias("j"), (a["q"] / (a["q"] + b["q"])).alias("s")))))
    games = per.select("l_orderkey", F.explode(meet).alias("g")).join(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("long").alias("item")), "l_orderkey")
    return tournaments.bradley_terry(games.select("item", "g.i", "g.j", "g.s"))


def _swiss_sql(rounds: int) -> str:
    won = "CASE WHEN j IS NULL OR i * 7919 % 97 > j * 7919 % 97 THEN 1.0 ELSE 0.0 END"
    out = ["s0 AS (SELECT CAST(s_nationkey AS BIGINT) AS item, s_suppkey AS player, CAST(0 AS DOUBLE) AS score FROM supplier)"]
    for k in range(rounds):
        out.append(f"r{k} AS (SELECT item, player, row_number() OVER (PARTITION BY item ORDER BY score DESC, player) - 1 AS r FROM s{k})")
        out.append(f"g{k} AS (SELECT item, min_by(player, r) AS i, CASE WHEN count(*) = 2 THEN max_by(player, r) END AS j FROM r{k} GROUP BY item, r // 2)")
        out.append(f"p{k} AS (SELECT item, i AS player, {won} AS p FROM g{k} UNION ALL SELECT item, j, 1 - {won} FROM g{k} WHERE j IS NOT NULL)")
        out.append(f"s{k + 1} AS (SELECT item, player, CAST(score + p AS DOUBLE) AS score FROM s{k} JOIN p{k} USING (item, player))")
    return f"WITH {', '.join(out)} SELECT * FROM s{rounds}"


@query(_swiss_sql(4))
def swiss_tournament(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("item"), F.col("s_suppkey").alias("player"))
    return tournaments.swiss(s, lambda i, j: F.when(i * 7919 % 97 > j * 7919 % 97, 1.0).otherwise(0.0))


@query("""WITH b AS (SELECT s_nationkey AS item, s_suppkey % 5 AS player, s_acctbal AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey % 5) AS r FROM supplier)
SELECT player, count(*) AS n_items FROM b WHERE r = 1 GROUP BY 1""")
def winner_histogram(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("item"), (F.col("s_suppkey") % 5).alias("player"), F.col("s_acctbal").alias("score"))
    return tournaments.winners(s)


@query("""SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rank FROM part) WHERE rank <= 3""")
def topk_pool(spark, sf_dir):
    return metrics.top_k(views.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 3)


@query("""WITH n AS (SELECT p_size AS item, p_partkey % 3 AS o, p_type AS k, count(*) AS n FROM part GROUP BY 1, 2, 3), z AS (SELECT item, o, sum(n) AS z FROM n GROUP BY 1, 2),
s AS (SELECT a.item, a.o AS a, b.o AS b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM n a JOIN n b ON a.item = b.item AND a.k = b.k AND a.o < b.o GROUP BY 1, 2, 3)
SELECT CAST(s.item AS BIGINT) AS item, a, b, shared, round(shared / (x.z + y.z - shared), 9) AS iou FROM s JOIN z x ON x.item = s.item AND x.o = a JOIN z y ON y.item = s.item AND y.o = b""")
def ruleset_iou(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_size").alias("item"), (F.col("p_partkey") % 3).alias("owner"), F.col("p_type").alias("key"))
    return metrics.overlaps(p, "item", "owner", "key").withColumn("iou", F.round("iou", 9))


@query("""WITH l AS (SELECT user_id AS run, ts, event_id, CAST(floor(value) AS BIGINT) AS iter FROM events),
m AS (SELECT *, min(iter) OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM l) SELECT run, event_id, iter FROM m WHERE after IS NULL OR after > iter""")
def log_size_compaction(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("o"), "event_id", F.floor("value").cast("long").alias("iter"))
    return files.latest(ev, "run", "o", "iter").select("run", "event_id", "iter")


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS seconds FROM events")
def log_durations(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("o"))
    return files.durations(ev, "user_id", "o", "ts").select("event_id", F.round("seconds", 3).alias("seconds"))


@query("SELECT c_custkey, split_part(c_nationkey || ':' || c_custkey, ':', 1) AS graph, CAST(c_custkey AS VARCHAR) AS node FROM customer")
def prefix_extract(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").withColumn("name", F.concat_ws(":", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", identifiers.prefix(F.col("name")).alias("graph"), identifiers.suffix(F.col("name")).alias("node"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS key FROM part GROUP BY 1")
def set_to_key(spark, sf_dir):
    return views.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(identifiers.set_key(F.collect_list("p_size")).cast("array<string>"), ",").alias("key"))


@query(f"""WITH {ORDERS}, m AS (SELECT max(i) AS width FROM n), t AS (SELECT g, dst, list(DISTINCT src) AS f FROM e GROUP BY 1, 2)
SELECT n.g AS graph_id, n.i AS node_id, array_to_string([CAST(lab = x AS INT) FOR x IN ['A', 'N', 'R']], '') || array_to_string([CAST(coalesce(list_contains(f, k), false) AS INT) FOR k IN range(1, width)], '') AS row
FROM n CROSS JOIN m LEFT JOIN t ON t.g = n.g AND t.dst = n.i""")
def node_string(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return tokens.node_strings(g.nodes, g.edges, ["A", "N", "R"]).withColumn("row", F.array_join(F.col("row").cast("array<string>"), ""))


@query("""WITH s AS (SELECT conv_id AS graph_id, list(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END ORDER BY turn DESC) AS t FROM conversations GROUP BY 1), m AS (SELECT max(len(t)) AS width FROM s)
SELECT graph_id, array_to_string([coalesce(t[k], 9) FOR k IN range(1, width + 1)], ' ') AS tokens, array_to_string([CAST(k <= len(t) AS INT) FOR k IN range(1, width + 1)], ' ') AS mask FROM s CROSS JOIN m""")
def token_sequences(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    code = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    s = tokens.rule_sequences(c.select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("seq"), code.alias("rule_id")))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    n = tokens.longest(s, "rules")
    return s.select("graph_id", text(tokens.padded(F.col("rules"), n, 9)).alias("tokens"), text(tokens.mask(F.col("rules"), n)).alias("mask"))


@query("""SELECT 'region:' || r_regionkey AS root, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1""")
def geo_leaves(spark, sf_dir):
    g = views.geo_graph(spark, sf_dir)
    up = traversal.closure(g.edges).where("src LIKE 'region:%' AND (dst LIKE 'customer:%' OR dst LIKE 'supplier:%')")
    return up.groupBy(F.col("src").alias("root")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def connected_components(spark, sf_dir):
    """Orders linked to the same customer's next one: a chain for each customer."""
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return components.components(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), after.alias("b")))


@query("""WITH f AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, p_brand, p_type FROM f WHERE k = 1""")
def non_isomorphic(spark, sf_dir):
    return matching.first_of_each(views.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "p_partkey")


@query("""SELECT DISTINCT l_orderkey AS mol, CAST(least(a, b) AS BIGINT) AS a, CAST(greatest(a, b) AS BIGINT) AS b FROM (SELECT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x JOIN lineitem y
ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND (x.l_suppkey % 5 IN (y.l_suppkey % 5, y.l_partkey % 5 + 5) OR x.l_partkey % 5 + 5 IN (y.l_suppkey % 5, y.l_partkey % 5 + 5)))""")
def line_graph(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return primitives.line_graph(lines.select(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("bond"), F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5 + 5).alias("atoms")))


@query("""WITH c AS (SELECT o_orderkey AS hg_id, o_custkey % 7 AS arity, o_orderpriority AS form FROM orders),
r AS (SELECT CAST(p_brand[7:8] AS BIGINT) AS rule_id, p_partkey % 7 AS arity, CASE p_size % 2 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END AS form, sum(p_size) AS count FROM part GROUP BY 1, 2, 3),
m AS (SELECT hg_id, rule_id, count / count(*) OVER (PARTITION BY hg_id, rule_id) AS w FROM c JOIN r USING (arity, form)) SELECT hg_id, CAST(0 AS BIGINT) AS edge, rule_id, round(w / sum(w) OVER (PARTITION BY hg_id), 9) AS weight FROM m""")
def rule_choices(spark, sf_dir):
    """A rule for each brand, arity and form of all parts, so that choices grow with the orders alone."""
    o, p = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "part")
    c = o.select(F.col("o_orderkey").alias("hg_id"), F.lit(0).alias("edge"), (F.col("o_custkey") % 7).alias("arity"), F.col("o_orderpriority").alias("form"))
    r = p.groupBy(F.substring("p_brand", 7, 2).cast("int").alias("rule_id"), (F.col("p_partkey") % 7).alias("arity"), F.when(F.col("p_size") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("form")).agg(F.sum("p_size").alias("count"))
    return hypergraphs.choices(c, r).withColumn("weight", F.round("weight", 9))


@query("""WITH s AS (SELECT l_orderkey AS seq_id, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS form FROM lineitem GROUP BY 1)
SELECT seq_id, n AS n_nodes, n - 1 AS n_edges, min(seq_id) OVER (PARTITION BY form) AS first, CAST(NULL AS VARCHAR) AS problem FROM s""")
def derive_sequences(spark, sf_dir):
    """Each order's chain of flags derived by its rules; first is the least order that the same graph came from."""
    made = rewriting.derive_all(_flag_sequences(spark, sf_dir), _flag_rules(), fixtures.NONTERMINALS)
    first = made.groupBy("form").agg(F.min("seq_id").alias("first"))
    return made.join(first, "form").select("seq_id", "n_nodes", "n_edges", "first", "problem")


@query("""SELECT l_orderkey AS id, array_to_string([CASE k // 3 WHEN 0 THEN n = 1 WHEN 1 THEN n > 1 AND n <> 8 WHEN 2 THEN n > 1 ELSE n = 1 END FOR k IN range(12)], ',') AS mask
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def legal_masks(spark, sf_dir):
    """Which rules can make each order's last line, where the eighth one must be the last."""
    from weftgraph.operators.masks import masks

    states = _flag_sequences(spark, sf_dir).select(F.col("seq_id").alias("id"), F.slice("rules", F.lit(1), F.size("rules") - 1).alias("rules"))
    return masks(states, _flag_rules(), fixtures.NONTERMINALS, most=8).withColumn("mask", F.array_join(F.col("mask").cast("array<string>"), ","))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
s AS (SELECT g, i, n, CAST(x + CASE WHEN n = 1 THEN 9 WHEN i = 1 THEN 0 WHEN i = n THEN 6 ELSE 3 END AS INT) AS r FROM l), c AS (SELECT a.r AS last, b.r, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND b.i = a.i + 1 GROUP BY 1, 2),
b AS (SELECT last, min_by(r, (-c, r)) AS r, min_by(r, (CASE WHEN r >= 6 THEN -c END, r)) FILTER (WHERE r >= 6) AS e FROM c GROUP BY 1),
d AS (SELECT g, [r] AS rules, r AS last FROM s WHERE i = 1 UNION ALL SELECT g, list_append(rules, z), z FROM (SELECT g, rules, CASE WHEN len(rules) = 7 THEN b.e ELSE b.r END AS z FROM d JOIN b ON b.last = d.last WHERE d.last < 6) WHERE z IS NOT NULL)
SELECT g AS id, array_to_string(max_by(rules, len(rules)), ',') AS rules, max_by(last, len(rules)) >= 6 AS ended FROM d GROUP BY 1""")
def decoded_chains(spark, sf_dir):
    """Each order's first line continued by the legal rule that most often follows the last one in all orders, to eight lines at most."""
    from weftgraph.operators.masks import decode

    seq = _flag_sequences(spark, sf_dir)
    follow = F.transform(F.slice("rules", F.lit(1), F.size("rules") - 1), lambda x, i: F.struct(x.alias("last"), F.get("rules", i + 1).alias("rule")))
    weights = seq.select(F.explode(follow).alias("x")).groupBy("x.last", "x.rule").agg(F.count("*").alias("weight"))
    made = decode(seq.select(F.col("seq_id").alias("id"), F.slice("rules", 1, 1).alias("rules")), _flag_rules(), fixtures.NONTERMINALS, weights, most=8)
    return made.withColumn("rules", F.array_join(F.col("rules").cast("array<string>"), ","))


def _flag_rules():
    """Rules 0 to 2 begin a chain with A, N or R, 3 to 5 go on, 6 to 8 end it, 9 to 11 are chains of one."""
    from weftgraph.operators.rewriting import Rule

    emb = frozenset((x, "black", "black", 0, "in", "in") for x in "ANR")
    step = ((0, 1, "black"),)
    return [Rule(s, (x, *more), step if more else (), e) for s, more, e in (("black", ("gray",), frozenset()), ("gray", ("gray",), emb), ("gray", (), emb), ("black", (), frozenset())) for x in "ANR"]


def _flag_sequences(spark, sf_dir):
    """seq_id, rules: how the rules make each order's lines, one after the other."""
    g = views.order_graphs(spark, sf_dir)
    labels = g.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "label"))).alias("x"))
    n = F.size("x")
    kind = lambda i: F.when(n == 1, 9).when(i == 0, 0).when(i == n - 1, 6).otherwise(3)
    return labels.select(F.col("graph_id").alias("seq_id"), F.transform("x", lambda v, i: kind(i) + F.locate("R", v["label"]) * 2 + F.locate("N", v["label"])).alias("rules"))


@query()
def learn_grammar(spark, sf_dir):
    return learning.grammar(views.order_graphs(spark, sf_dir))


@query(f"""WITH {ORDERS} SELECT sl AS src_label, dl AS dst_label, CAST(count(DISTINCT g) AS BIGINT) AS n_graphs FROM e GROUP BY 1, 2""")
def extract_motifs(spark, sf_dir):
    return learning.motifs(learning.candidates(views.order_graphs(spark, sf_dir), "gray"))


@query("""SELECT g AS graph_id, min(g) OVER (PARTITION BY form) AS first FROM (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS g, string_agg(event_type, ',' ORDER BY ts, event_id) AS form FROM events GROUP BY 1)""")
def unrolled_hash(spark, sf_dir):
    """The least graph of the same hash; chains share it if their labels are the same in order."""
    g = views.event_graphs(spark, sf_dir)
    h = traversal.per_graph(g, lambda n, e: iter([(traversal.unrolled_hash(n, e),)]), "h string")
    return h.select("graph_id", F.min("graph_id").over(W.partitionBy("h")).alias("first"))


@query("""WITH r AS (SELECT p_partkey AS rule_id, '(' || p_size || ',' || p_brand[7:8] || ':N)(a,b:T)(x' || p_size % 3 || ':' || CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'T' END || ')' AS text FROM part),
m AS (SELECT rule_id, unnest(regexp_extract_all(text, '\\(((?:\\w+,)*\\w+):([NT])\\)', 1)) AS n, unnest(regexp_extract_all(text, '\\(((?:\\w+,)*\\w+):([NT])\\)', 2)) AS k, unnest(range(0, 3)) AS pos FROM r)
SELECT rule_id, pos, n AS nodes, k = 'N' AS is_nonterminal FROM m""")
def production_edges(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "N").otherwise("T")
    text = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(","), F.substring("p_brand", 7, 2), F.lit(":N)(a,b:T)(x"), (F.col("p_size") % 3).cast("string"), F.lit(":"), kind, F.lit(")"))
    return productions.edges(p.select(F.col("p_partkey").alias("rule_id"), text.alias("text"))).withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH {ORDERS}, h AS (SELECT DISTINCT g FROM e WHERE sl = 'A' AND dl = 'R') SELECT count(*) AS n_graphs, round(avg(CASE WHEN h.g IS NULL THEN 0.0 ELSE 1.0 END), 9) AS share FROM (SELECT DISTINCT g FROM n) k LEFT JOIN h ON h.g = k.g")
def share_containing(spark, sf_dir):
    g = views.order_graphs(spark, sf_dir)
    return metrics.share_containing(g.nodes, matching.containing(g, matching.Pattern(("A", "R"), ((0, 1, None),)))).withColumn("share", F.round("share", 9))


@query("SELECT p_brand AS symbol, count(DISTINCT p_type) AS n_rules FROM part GROUP BY 1")
def rules_per_symbol(spark, sf_dir):
    return productions.symbols(views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("rule_id")))


@query()
def equal_mass_sample(spark, sf_dir):
    return metrics.equal_mass(views.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query()
def derivation_parses(spark, sf_dir):
    from weftgraph.operators.derivations import all_derivations

    graphs, rules = _turn_grammar(spark, sf_dir)
    found = all_derivations(graphs, rules, {"gray", "black"})
    return found.select("graph_id", F.size("derivations").alias("n_derivations"), "problem")


@query("""SELECT conv_id AS graph_id, CAST(CASE WHEN count(*) > 1 AND min_by(role, turn) = 'user' AND bool_and(role IN ('user', 'assistant')) THEN 1 ELSE 0 END AS BIGINT) AS n_derivations
FROM conversations GROUP BY 1""")
def derivation_counts(spark, sf_dir):
    """The number of derivations of each conversation as a chain of turns, which a user begins."""
    from weftgraph.operators import frontier

    return frontier.derivation_counts(*_turn_grammar(spark, sf_dir), {"gray", "black"})


@query("""WITH c AS (SELECT conv_id AS graph_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1 AND min_by(role, turn) = 'user' AND bool_and(role IN ('user', 'assistant')))
SELECT graph_id, '0' || repeat(',5', CAST((n - 2 - n % 2) // 2 AS INT)) || CASE WHEN n % 2 = 0 THEN ',3' ELSE ',7' END AS rules, CAST(1 AS BIGINT) AS n_left FROM c""")
def unambiguous_derivations(spark, sf_dir):
    """Conversations under rules that add one turn or two, and the derivation each has once the grammar is made unambiguous."""
    from weftgraph.operators import ambiguity
    from weftgraph.operators.derivations import all_derivations
    from weftgraph.operators.rewriting import Rule

    graphs, rules = _turn_grammar(spark, sf_dir)
    step = rules[1].embedding
    two = [Rule("gray", ("assistant", "user", "gray"), ((0, 1, "black"), (1, 2, "black")), step), Rule("gray", ("user", "assistant", "gray"), ((0, 1, "black"), (1, 2, "black")), step), Rule("gray", ("assistant", "user"), ((0, 1, "black"),), step)]
    _, kept = ambiguity.deletions(ambiguity.listed(all_derivations(graphs, rules + two, {"gray", "black"})))
    return kept.select("graph_id", F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"), "n_left")


def _turn_grammar(spark, sf_dir):
    """Conversations as rows, and rules that make chains turn by turn."""
    from weftgraph.operators.rewriting import Rule

    emb = frozenset({("user", "black", "black", 0, "in", "in"), ("assistant", "black", "black", 0, "in", "in")})
    rules = [Rule("black", ("user", "gray"), ((0, 1, "black"),))] + [Rule("gray", x, ((0, 1, "black"),) if len(x) > 1 else (), emb) for x in (("assistant", "gray"), ("user", "gray"), ("assistant",), ("user",))]
    g = views.conversation_graphs(spark, sf_dir)
    nodes = g.nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "label")).alias("nodes"))
    edges = g.edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "label")).alias("edges"))
    return nodes.join(edges, "graph_id", "left"), rules


from weftgraph.plans import change_queries, circuit_queries, file_queries, hrg_queries, motif_queries, rule_queries  # noqa: E402, F401  register theirs beside these
