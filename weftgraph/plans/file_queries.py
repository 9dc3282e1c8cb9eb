"""Queries that write files in the formats of sources.files and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.functions import tokens
from weftgraph.operators import hypergraphs, productions
from weftgraph.operators.checkpoints import cut, folder, remove
from weftgraph.plans.registry import query
from weftgraph.sources import files, views


def _through(spark, write, read):
    """What read(path) gives of a folder that write(path) has filled; the folder goes again."""
    at = f"{folder(spark)}/files-{uuid.uuid4().hex}"
    write(at)
    out = cut(read(at))
    remove(spark, at)
    return out


@query("""WITH n AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations), k AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS graph_id, max(i) AS n FROM n GROUP BY 1)
SELECT DISTINCT graph_id, src, dst FROM (SELECT graph_id, unnest(range(0, n + 1)) AS src, unnest(range(1, n + 2)) AS dst FROM k
UNION ALL SELECT graph_id, a.i, b.i FROM n a JOIN n b ON a.g = b.g AND a.role = b.role AND a.i <= b.i - 2 JOIN k ON k.g = a.g)""")
def chains_read(spark, sf_dir):
    """Conversations as lines of architecture files, one line each in order, with a flag where an earlier turn has the same role."""
    c = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    code = lambda x: F.when(x == "user", 0).when(x == "assistant", 1).otherwise(2)
    flags = lambda x, i: F.transform(F.slice("r", 1, F.greatest(i - 1, F.lit(0))), lambda y: (y == x).cast("int"))
    lines = c.select("conv_id", F.concat(F.lit("("), F.to_json(F.transform("r", lambda x, i: F.concat(F.array(code(x)), flags(x, i)))), F.lit(", 0.5)")).alias("value"))
    return _through(spark, lambda at: lines.orderBy("conv_id").select("value").write.text(at), lambda at: files.read_chains(spark, at, 0, by_file=False)[0].edges.select("graph_id", "src", "dst"))


@query("""WITH n AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), k AS (SELECT g, row_number() OVER (ORDER BY g) AS graph_id FROM n GROUP BY 1)
SELECT CAST(graph_id AS BIGINT) AS graph_id, a.i AS src, b.i AS dst FROM n a JOIN n b ON a.g = b.g AND b.i = a.i + 1 JOIN k ON k.g = a.g""")
def miner_blocks(spark, sf_dir):
    """Conversation graphs as a miner's lines, and the blocks that these hold."""
    text = files.motif_lines(views.conversation_graphs(spark, sf_dir))
    lines = text.select("graph_id", F.posexplode(F.split("text", "\n")).alias("k", "value")).select(F.struct("graph_id", "k").alias("at"), "value")
    return files.motif_blocks(lines)[1].select("graph_id", "src", "dst")


@query("SELECT DISTINCT p_type AS smiles FROM part")
def molecules_read(spark, sf_dir):
    lines = views.table(spark, sf_dir, "part").select(F.concat_ws(",", "p_type", F.col("p_partkey").cast("string")).alias("value"))
    return _through(spark, lines.write.text, lambda at: files.read_molecules(spark, at).select("smiles"))


@query("SELECT CAST(n_nationkey * 100 + (SELECT max(r_regionkey) FROM region) AS BIGINT) AS id, n_name AS name FROM nation")
def snapshot_last(spark, sf_dir):
    """The last of several iterations' tables, one for each region; each holds the nations of all regions so far."""
    n, last = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region").agg(F.max("r_regionkey")).first()[0]

    def write(at):
        for k in range(last + 1):
            files.write_snapshot({"nations": n.where(F.col("n_regionkey") <= k).select((F.col("n_nationkey") * 100 + k).alias("id"), F.col("n_name").alias("name"))}, at, k)

    return _through(spark, write, lambda at: files.read_snapshot(spark, at, "nations"))


@query("""WITH t AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS edge FROM lineitem)
SELECT l_orderkey AS hg_id, edge, l_returnflag AS label, CAST(unnest([0, 1]) AS BIGINT) AS pos, unnest(['n' || l_partkey % 5, 'n' || l_suppkey % 5]) AS node FROM t""")
def hypergraph_incidence(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 5).cast("string"))
    edge = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(name("l_partkey"), name("l_suppkey")).alias("nodes"), F.col("l_returnflag").alias("label"))
    hg = lines.groupBy(F.col("l_orderkey").alias("hg_id")).agg(F.array_sort(F.collect_list(edge)).alias("E"))
    return hypergraphs.incidence(hg)


@query("SELECT CAST(p_size AS BIGINT) AS rule_id, row_number() OVER (ORDER BY p_size) - 1 AS token FROM part GROUP BY p_size")
def dense_tokens(spark, sf_dir):
    return tokens.dense_tokens(views.table(spark, sf_dir, "part").select(F.col("p_size").alias("rule_id")))


@query("SELECT symbol, rule_id FROM (SELECT p_brand AS symbol, p_partkey AS rule_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k = 2")
def second_rule(spark, sf_dir):
    return productions.nth_rule(views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("rule_id")), 1)
