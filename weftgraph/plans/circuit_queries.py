"""Queries over circuits: paths, numbering and the text form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators import paths
from weftgraph.plans.registry import query
from weftgraph.sources.views import Graphs, table

#: The inner cells by supplier.
CELLS = ["R", "C", "+gm+", "-gm+", "+gm-", "-gm-"]

#: circuit_graphs and their simple paths in SQL.
CIRCUITS = f"""l AS (SELECT l_orderkey AS g, l_suppkey AS s, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
n AS (SELECT g, i, m, p, f, CASE WHEN i = 1 THEN 'input' WHEN i = m THEN 'output' ELSE {CELLS}[s % 6 + 1] END AS lab FROM l),
e AS (SELECT a.g, a.i AS src, b.i AS dst FROM n a JOIN n b ON a.g = b.g AND (b.i = a.i + 1 OR b.i = a.i + 2 AND a.f = b.f OR b.i = a.i - 1 AND b.i > 1 AND a.i < a.m AND a.p % 4 = 0)),
w AS (SELECT g, [1] AS path, 1 AS i, 0 AS gm FROM n WHERE i = 1 UNION ALL SELECT w.g, list_append(w.path, e.dst), e.dst, w.gm + CASE WHEN lab LIKE '%gm%' THEN 1 ELSE 0 END FROM w JOIN e ON e.g = w.g AND e.src = w.i JOIN n ON n.g = e.g AND n.i = e.dst WHERE NOT list_contains(w.path, e.dst)),
b AS (SELECT w.g, w.path, w.gm, row_number() OVER (PARTITION BY w.g ORDER BY w.gm DESC, len(w.path), w.path) AS r FROM w JOIN n USING (g, i) WHERE lab = 'output'),
mp AS (SELECT a.g, coalesce(b.path, []) AS path, CAST(coalesce(b.gm, 0) AS BIGINT) AS stages FROM (SELECT DISTINCT g FROM n) a LEFT JOIN b ON b.g = a.g AND b.r = 1)"""

#: numbered() in SQL.
NUMBERS = f"""{CIRCUITS}, z AS (SELECT g, count(*) AS size FROM n GROUP BY 1), o AS (SELECT g, unnest(path) AS i FROM mp),
near AS (SELECT g, count(*) AS near FROM (SELECT g, i FROM o UNION SELECT e.g, e.src FROM e JOIN o ON o.g = e.g AND o.i = e.dst) GROUP BY 1),
q AS (SELECT mp.g, path, stages, CASE WHEN stages NOT IN (2, 3) THEN stages || ' stages' WHEN near <> size THEN 'a node neither is on the main path nor leads into it' WHEN len(path) <> stages + 2 THEN 'another cell than a gain cell is on the main path' END AS problem FROM mp JOIN z ON z.g = mp.g LEFT JOIN near ON near.g = mp.g),
k AS (SELECT n.g, n.i, n.lab, stages, problem, path, list_position(path, n.i) AS pos, row_number() OVER (PARTITION BY n.g, list_contains(path, n.i) ORDER BY n.i) AS nth FROM n JOIN q ON q.g = n.g),
num AS (SELECT g, i, lab, stages, problem, CAST(CASE WHEN problem IS NOT NULL THEN NULL WHEN pos = 1 THEN 0 WHEN pos = len(path) THEN 1 WHEN pos > 1 THEN pos ELSE len(path) + nth - 1 END AS BIGINT) AS number FROM k)"""


def circuit_graphs(spark, sf_dir) -> Graphs:
    """A circuit for each order: its lines in order between the input and the output.

    Each feeds the next, the next but one if their flags match, and some inner ones the one before as well.
    """
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("graph_id"), F.row_number().over(w).cast("long").alias("node_id"), "l_suppkey", "l_partkey",
        (F.lead("l_returnflag", 2).over(w) == F.col("l_returnflag")).alias("skip"), F.lead("l_orderkey").over(w).isNull().alias("last"),
    )
    i = F.col("node_id")
    cell = F.element_at(F.array(*[F.lit(x) for x in CELLS]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    nodes = lines.select("graph_id", "node_id", F.when(i == 1, "input").when(F.col("last"), "output").otherwise(cell).alias("label"))
    to = F.array(F.when(~F.col("last"), i + 1), F.when(F.col("skip"), i + 2), F.when((i > 2) & ~F.col("last") & (F.col("l_partkey") % 4 == 0), i - 1))
    edges = lines.select("graph_id", i.alias("src"), F.explode(F.array_compact(to)).alias("dst"), F.lit("black").alias("label"))
    return Graphs(nodes, edges)


@query(f"WITH RECURSIVE {CIRCUITS} SELECT g AS graph_id, array_to_string(path, ',') AS path, stages FROM mp")
def circuit_main_paths(spark, sf_dir):
    return paths.main_paths(circuit_graphs(spark, sf_dir)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(f"WITH RECURSIVE {CIRCUITS} SELECT w.g AS graph_id, count(*) AS n_paths, CAST(max(len(path)) AS BIGINT) AS longest FROM w JOIN n USING (g, i) WHERE lab = 'output' GROUP BY 1")
def circuit_path_counts(spark, sf_dir):
    return paths.path_counts(circuit_graphs(spark, sf_dir), "input", "output")


@query(f"WITH RECURSIVE {NUMBERS} SELECT g AS graph_id, i AS node_id, number, stages, problem FROM num")
def circuit_numbers(spark, sf_dir):
    return paths.numbered(circuit_graphs(spark, sf_dir))


@query(f"""WITH RECURSIVE {NUMBERS}, pr AS (SELECT b.g, b.number, list_sort(list(a.number)) AS p FROM e JOIN num a ON a.g = e.g AND a.i = e.src JOIN num b ON b.g = e.g AND b.i = e.dst WHERE a.number IS NOT NULL GROUP BY 1, 2),
t AS (SELECT num.g, num.number, stages, concat_ws(' ', map {{'input': 0, 'output': 1, 'R': 2, 'C': 3, '+gm+': 6, '-gm+': 7, '+gm-': 8, '-gm-': 9}}[lab], num.number, num.number, coalesce(len(p), 0), CASE WHEN len(p) > 0 THEN array_to_string(p, ' ') END,
CASE num.number WHEN 0 THEN '1 8 0 1' WHEN 1 THEN '1 9 0 1' ELSE '-1 ' || repeat('11.11 ', coalesce(len(p), 0)) || '-1' END) AS line FROM num LEFT JOIN pr ON pr.g = num.g AND pr.number = num.number WHERE num.number IS NOT NULL),
x AS (SELECT g, count(*) || ' ' || count(*) || ' ' || min(stages) || chr(10) || string_agg(line, chr(10) ORDER BY number) || chr(10) AS text FROM t GROUP BY 1) SELECT q.g AS graph_id, text, problem FROM q LEFT JOIN x ON x.g = q.g""")
def circuit_texts(spark, sf_dir):
    return paths.texts(circuit_graphs(spark, sf_dir))


@query(f"""WITH RECURSIVE {CIRCUITS}, s AS (SELECT w.g, w.path, min(len(w.path)) OVER (PARTITION BY w.g) AS least FROM w JOIN n USING (g, i) WHERE lab = 'output'),
c AS (SELECT DISTINCT v.g, v.i FROM (SELECT g, unnest(path) AS i FROM s WHERE len(path) = least) v JOIN n ON n.g = v.g AND n.i = v.i WHERE lab IN ('-gm-', '+gm-')),
ok AS (SELECT DISTINCT c.g, c.i FROM c JOIN e a ON a.g = c.g AND a.dst = c.i JOIN e d ON d.g = c.g AND d.src = a.src JOIN n y ON y.g = c.g AND y.i = d.dst AND y.lab IN ('R', 'C') JOIN e u ON u.g = c.g AND u.src = y.i JOIN e t ON t.g = c.g AND t.src = c.i AND t.dst = u.dst)
SELECT k.g AS graph_id, k.g IN (SELECT g FROM s) AND k.g NOT IN (SELECT c.g FROM c LEFT JOIN ok ON ok.g = c.g AND ok.i = c.i WHERE ok.i IS NULL) AS bypassed FROM (SELECT DISTINCT g FROM n) k""")
def circuit_bypasses(spark, sf_dir):
    return paths.bypassed(circuit_graphs(spark, sf_dir))
