"""Readers and writers of graph, grammar, molecule and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.sources.views import Graphs

HYPERGRAPH = "struct<V:array<struct<id:string,label:string,kwargs:map<string,string>>>,E:array<struct<nodes:array<string>,label:string,kwargs:map<string,string>>>,ext:array<string>>"
GRAMMAR = f"N array<string>, T array<string>, S string, vocab map<string,int>, counts array<bigint>, rules array<struct<symbol:string,vocab:map<string,int>,rhs:{HYPERGRAPH}>>"


def read_hypergraphs(spark: SparkSession, path: str) -> DataFrame:
    """hg_id (the file's name), V, E, ext of one JSON hypergraph a file."""
    df = spark.read.schema(_as_columns(HYPERGRAPH[len("struct<") : -1])).json(path, multiLine=True)
    return df.select(F.col("_metadata.file_name").alias("hg_id"), "V", "E", "ext")


def _as_columns(fields: str) -> str:
    """The outer fields of a struct as a schema."""
    depth, out = 0, []
    for c in fields:
        depth += {"<": 1, ">": -1}.get(c, 0)
        out.append(" " if c == ":" and not depth else c)
    return "".join(out)


def read_grammars(spark: SparkSession, path: str) -> DataFrame:
    """grammar_id (the file's name) and the fields of one JSON grammar a file."""
    df = spark.read.schema(GRAMMAR).json(path, multiLine=True)
    return df.select(F.col("_metadata.file_name").alias("grammar_id"), "N", "T", "S", "vocab", "counts", "rules")


def grammar_rules(grammars: DataFrame) -> DataFrame:
    """grammar_id, rule_id, symbol, rhs, count."""
    rules = grammars.select("grammar_id", "counts", F.posexplode("rules").alias("rule_id", "r"))
    return rules.select("grammar_id", "rule_id", F.col("r.symbol").alias("symbol"), F.col("r.rhs").alias("rhs"), F.get("counts", F.col("rule_id")).alias("count"))


def as_json(df: DataFrame, key: str) -> DataFrame:
    """key and value: the other columns as a JSON object."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("value"))


def read_node_link(spark: SparkSession, path: str, every: int = 1) -> tuple[Graphs, DataFrame]:
    """Graphs of one node-link JSON file each, named by a number, and graphs(graph_id, attrs).

    Only those whose number every divides are kept. Edges get the label black.
    """
    schema = "graph map<string,double>, nodes array<struct<id:int,type:int,feat:double>>, links array<struct<source:int,target:int>>"
    df = spark.read.schema(schema).json(path, multiLine=True).withColumn("graph_id", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long")).where(F.col("graph_id") % every == 0)
    nodes = df.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.col("n.id").alias("node_id"), F.col("n.type").cast("string").alias("label"), F.coalesce("n.feat", F.lit(0.0)).alias("feat"))
    edges = df.select("graph_id", F.explode("links").alias("e")).select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.lit("black").alias("label"))
    return Graphs(nodes, edges), df.select("graph_id", F.col("graph").alias("attrs"))


def _numbered(lines: DataFrame, by_file: bool) -> DataFrame:
    """lines(file, at, ...) with nth: their place in each file, or in all files by name, from 0.

    at rises inside a part of a file that a task reads. Only the parts' sizes are ordered in one
    place; lines stay where they are read.
    """
    lines = lines.withColumn("part", F.shiftright("at", 33))
    parts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = (W.partitionBy("file").orderBy("part") if by_file else W.orderBy("file", "part")).rowsBetween(W.unboundedPreceding, -1)
    start = parts.select("file", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return lines.join(F.broadcast(start), ["file", "part"]).withColumn("nth", F.col("at") + F.col("start"))  # a row for each part that a task reads


def _rows(spark: SparkSession, path: str, skip: int, by_file: bool = True) -> DataFrame:
    """graph_id, row, y of lines (row, y); graph_id numbers the lines after the skipped ones in each file, or in all files by name, by offset."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    body = F.regexp_extract("value", r"^\s*\(\s*(\[.*\])\s*,\s*([-+0-9.eE]+)\s*\)\s*$", 1)
    y = F.regexp_extract("value", r"^\s*\(\s*(\[.*\])\s*,\s*([-+0-9.eE]+)\s*\)\s*$", 2)
    return _numbered(lines, by_file).where(F.col("nth") >= skip).select((F.col("nth") - skip).alias("graph_id"), F.from_json(body, "array<array<int>>").alias("row"), y.cast("double").alias("y"))


def read_chains(spark: SparkSession, path: str, skip: int = 1000, by_file: bool = True) -> tuple[Graphs, DataFrame]:
    """Architectures, a line each: item i is [type, flag for each earlier item but the last]; and graphs(graph_id, acc).

    Node 0 is the input and the last one the output; each node follows the one
    before it, and item i follows item j as well if its flag j is set.
    """
    rows = _rows(spark, path, skip, by_file)
    items = rows.select("graph_id", F.size("row").alias("n"), F.posexplode("row").alias("i", "item"))
    nodes = items.select("graph_id", (F.col("i") + 1).alias("node_id"), (F.col("item")[0] + 2).cast("string").alias("label"))
    ends = rows.select("graph_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("0").alias("x")), F.struct((F.size("row") + 1).alias("k"), F.lit("1").alias("x")))).alias("e")).select("graph_id", F.col("e.k").alias("node_id"), F.col("e.x").alias("label"))
    chain = rows.select("graph_id", F.explode(F.sequence(F.lit(0), F.size("row"))).alias("src")).select("graph_id", "src", (F.col("src") + 1).alias("dst"))
    flags = items.select("graph_id", "i", F.posexplode(F.slice("item", 2, F.size("item"))).alias("j", "flag")).where("flag = 1")
    skips = flags.select("graph_id", (F.col("j") + 1).alias("src"), (F.col("i") + 1).alias("dst"))
    edges = chain.unionByName(skips).distinct().withColumn("label", F.lit("black"))
    return Graphs(nodes.unionByName(ends), edges), rows.select("graph_id", F.col("y").alias("acc"))


def read_networks(spark: SparkSession, path: str) -> tuple[Graphs, DataFrame]:
    """Bayesian networks, a line each: item i is [type, flag for each earlier item]; and graphs(graph_id, bic).

    Nodes without a parent hang from the input, nodes without a child lead to the output. All have equally many nodes.
    """
    rows = _rows(spark, path, 0)
    least, most = rows.agg(F.min(F.size("row")), F.max(F.size("row"))).first()
    if least != most:
        raise ValueError(f"networks have from {least} to {most} nodes")
    rows = rows.withColumn("size", F.size("row"))
    items = rows.select("graph_id", "size", F.posexplode("row").alias("i", "item"))
    nodes = items.select("graph_id", (F.col("i") + 1).alias("node_id"), (F.col("item")[0] + 2).cast("string").alias("label"))
    ends = rows.select("graph_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("0").alias("x")), F.struct((F.col("size") + 1).alias("k"), F.lit("1").alias("x")))).alias("e")).select("graph_id", F.col("e.k").alias("node_id"), F.col("e.x").alias("label"))
    inner = items.select("graph_id", "i", F.posexplode(F.slice("item", 2, F.size("item"))).alias("j", "flag")).where("flag = 1").select("graph_id", (F.col("j") + 1).alias("src"), (F.col("i") + 1).alias("dst"))
    own = nodes.select("graph_id", "node_id")
    top = own.join(inner.select("graph_id", F.col("dst").alias("node_id")), ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit(0).alias("src"), F.col("node_id").alias("dst"))
    last = rows.select("graph_id", "size")
    sinks = own.join(inner.select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_anti").join(last, "graph_id").select("graph_id", F.col("node_id").alias("src"), (F.col("size") + 1).alias("dst"))
    edges = inner.unionByName(top).unionByName(sinks).withColumn("label", F.lit("black"))
    return Graphs(nodes.unionByName(ends), edges), rows.select("graph_id", F.col("y").alias("bic"))


def read_molecules(spark: SparkSession, path: str, canonical: Column | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """ord, smiles: the first field of each line, each once, at its first place; sample: so many by a seeded hash.

    canonical is a column of the field smiles, for toolkits that can make one; without it, text counts.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("smiles")).where("smiles <> ''")
    if canonical is not None:
        lines = lines.withColumn("smiles", canonical)
    once = lines.groupBy("smiles").agg(F.min("ord").alias("ord")).select("ord", "smiles")
    return once if sample is None else once.orderBy(F.xxhash64(F.lit(seed), "smiles"), "smiles").limit(sample)


def motif_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a miner's output lines(at, value): `v id label` and `d u v label` lines; a v line with id 1 starts a block.

    Lines are dealt by ranges of at; blocks are numbered inside a range, from where the ranges before it end.
    """
    kind = F.regexp_extract("value", r"^\s*([vd])\s", 1)
    v = F.regexp_extract("value", r"^\s*v\s+(\d+)\s+(\S+)", 1)
    rows = lines.select("at", "value", kind.alias("kind"), (v == "1").cast("int").alias("new")).where("kind <> ''")
    rows = cut(rows.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = rows.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.join(F.broadcast(start), "part").withColumn("graph_id", F.col("start") + F.sum("new").over(W.partitionBy("part").orderBy("at")))
    nodes = rows.where("kind = 'v'").select("graph_id", F.regexp_extract("value", r"v\s+(\d+)", 1).cast("int").alias("node_id"), F.regexp_extract("value", r"v\s+\d+\s+(\S+)", 1).alias("label"))
    part = lambda k: F.regexp_extract("value", r"d\s+(\d+)\s+(\d+)\s*(\S*)", k)
    return nodes, rows.where("kind = 'd'").select("graph_id", part(1).cast("int").alias("src"), part(2).cast("int").alias("dst"), F.lit("black").alias("label"))


def motif_lines(g: Graphs) -> DataFrame:
    """graph_id, text: a graph as `v id label` and `d u v on` lines, ids from 1."""
    nth = F.row_number().over(W.partitionBy("graph_id").orderBy("node_id"))
    n = g.nodes.select("graph_id", "node_id", "label", nth.alias("k"))
    e = g.edges.join(n.select("graph_id", F.col("node_id").alias("src"), F.col("k").alias("u")), ["graph_id", "src"]).join(n.select("graph_id", F.col("node_id").alias("dst"), F.col("k").alias("v")), ["graph_id", "dst"])
    v = n.select("graph_id", F.struct(F.lit(0).alias("s"), F.col("k").alias("a"), F.lit(0).alias("b"), F.format_string("v %d %s", "k", "label").alias("line")).alias("x"))
    d = e.select("graph_id", F.struct(F.lit(1).alias("s"), F.col("u").alias("a"), F.col("v").alias("b"), F.format_string("d %d %d on", "u", "v").alias("line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return v.unionByName(d).groupBy("graph_id").agg(F.array_join(lines, "\n").alias("text"))


def groups(text: Column) -> Column:
    """Groups of numbers in lines `name:1,2,3` or `1,2,3`."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"\d")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^[^:]*:|\s", ""), ","), lambda y: y.cast("int")))


def latest(rows: DataFrame, run: str, order: str, iteration: str) -> DataFrame:
    """Log rows without those that a restart took back: a row goes if a later one of its run has the same or an earlier iteration."""
    after = F.min(iteration).over(W.partitionBy(run).orderBy(order).rowsBetween(1, W.unboundedFollowing))
    return rows.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") > F.col(iteration))).drop("_after")


def durations(rows: DataFrame, run: str, order: str, time: str) -> DataFrame:
    """rows with seconds since the row before, null for a run's first."""
    before = F.lag(time).over(W.partitionBy(run).orderBy(order))
    return rows.withColumn("seconds", F.unix_micros(F.col(time).cast("timestamp")) / 1e6 - F.unix_micros(before.cast("timestamp")) / 1e6)


def next_version(names: DataFrame) -> DataFrame:
    """version: one more than the greatest number that a name(name) without its ending is; 0 without any."""
    number = F.regexp_extract("name", r"^(\d+)(\.[^.]*)?$", 1)
    return names.agg((F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(-1)) + 1).alias("version"))


def write_snapshot(frames: dict[str, DataFrame], root: str, iteration: int) -> None:
    """Each table of a grammar's state as Parquet below root/name/iter=n."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/iter={iteration}")


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last iteration that root holds."""
    df = spark.read.parquet(f"{root}/{name}")
    last = df.agg(F.max("iter")).first()[0]
    return df.where(F.col("iter") == last).drop("iter")
