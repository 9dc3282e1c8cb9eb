import json

from pyspark.sql import functions as F

from weftgraph.functions import identifiers, tokens
from weftgraph.operators import hypergraphs
from weftgraph.plans import fixtures
from weftgraph.sources import files, views
from weftgraph.streaming import queue


def test_hypergraphs_and_grammars_round_trip(spark, tmp_path):
    name, g, tests = fixtures.membership_cases()[1]
    (tmp_path / "g").mkdir()
    (tmp_path / "h").mkdir()
    (tmp_path / "g" / "abc.hrg").write_text(g)
    for k, (h, _) in enumerate(tests):
        (tmp_path / "h" / f"{k}.hg").write_text(h)
    grammars = files.read_grammars(spark, str(tmp_path / "g"))
    graphs = files.read_hypergraphs(spark, str(tmp_path / "h"))
    assert files.grammar_rules(grammars).count() == 4
    assert hypergraphs.incidence(graphs.where("hg_id = '2.hg'")).count() == 6
    pairs = files.as_json(graphs, "hg_id").withColumnsRenamed({"hg_id": "id", "value": "hg"}).join(files.as_json(grammars, "grammar_id").select(F.col("value").alias("grammar")))
    got = {r.id: r.member for r in hypergraphs.membership(pairs).collect()}
    assert got == {f"{k}.hg": m for k, (_, m) in enumerate(tests)}
    assert json.loads(pairs.first().grammar) == json.loads(g)
    assert grammars.select(F.size("rules")).first()[0] == 4 and grammars.first().S == "S"


def test_line_formats(spark, tmp_path):
    (tmp_path / "enas.txt").write_text("([[9]], 0.1)\n([[3], [2, 1], [5, 1, 0]], 0.75)\nnonsense\n")
    g, acc = files.read_chains(spark, str(tmp_path / "enas.txt"), skip=1)
    own = g.edges.where("graph_id = 0").select("src", "dst").orderBy("src", "dst").collect()
    assert [tuple(r) for r in own] == [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)] and acc.where("graph_id = 0").first().acc == 0.75
    (tmp_path / "bn.txt").write_text("([[0], [1, 1], [2, 0, 0]], -3.5)\n")
    g, bic = files.read_networks(spark, str(tmp_path / "bn.txt"))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 1), (0, 3), (1, 2), (2, 4), (3, 4)] and bic.first().bic == -3.5
    (tmp_path / "mols.txt").write_text("CC,1\nCO\nCC\n\nN\n")
    assert [r.smiles for r in files.read_molecules(spark, str(tmp_path / "mols.txt")).orderBy("ord").collect()] == ["CC", "CO", "N"]
    assert files.read_molecules(spark, str(tmp_path / "mols.txt"), sample=2).count() == 2


def test_node_link_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"ckt_{k}.json").write_text(json.dumps({"graph": {"fom": k + 0.5}, "nodes": [{"id": 0, "type": 1}, {"id": 1, "type": 2, "feat": 3.5}], "links": [{"source": 0, "target": 1}]}))
    g, attrs = files.read_node_link(spark, str(tmp_path), every=2)
    assert sorted({r.graph_id for r in g.nodes.collect()}) == [0, 2] and {r.feat for r in g.nodes.collect()} == {0.0, 3.5}
    assert {r.graph_id: r.attrs["fom"] for r in attrs.collect()} == {0: 0.5, 2: 2.5} and g.edges.count() == 2


def test_motif_lines_round_trip(spark):
    g = views.conversation_graphs(spark, "/root/testdata/sf0.001")
    g = views.Graphs(g.nodes.where("graph_id < 3"), g.edges.where("graph_id < 3"))
    text = "\n".join(r.text for r in files.motif_lines(g).orderBy("graph_id").collect())
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "at long, value string")
    nodes, edges = files.motif_blocks(lines)
    assert nodes.count() == g.nodes.count() and edges.count() == g.edges.count()


def test_logs_groups_and_versions(spark):
    log = spark.createDataFrame([("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("r", 4, 1), ("r", 5, 2)], "run string, at int, iter int")
    assert sorted(r["at"] for r in files.latest(log, "run", "at", "iter").collect()) == [1, 4, 5]
    row = spark.createDataFrame([("a:1, 2,3\nnone\n4,5",)], "t string").select(files.groups(F.col("t")).alias("g")).first()
    assert row.g == [[1, 2, 3], [4, 5]]
    assert files.next_version(spark.createDataFrame([("3.pkl",), ("10",), ("x.pkl",)], "name string")).first().version == 11
    assert files.next_version(spark.createDataFrame([], "name string")).first().version == 0


def test_snapshots_and_ids(spark, tmp_path):
    for k in (1, 2, 10):
        files.write_snapshot({"rules": spark.range(k)}, str(tmp_path), k)
    assert files.read_snapshot(spark, str(tmp_path), "rules").count() == 10
    new = identifiers.next_ids(spark.createDataFrame([(1, 5)], "graph_id long, node_id int"), spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "graph_id long, ord int"))
    assert sorted((r.graph_id, r.node_id) for r in new.collect()) == [(1, 6), (1, 7), (2, 0)]


def test_node_strings_round_trip(spark):
    g = views.order_graphs(spark, "/root/testdata/sf0.001")
    rows = tokens.node_strings(g.nodes, g.edges, ["A", "N", "R"], 20)
    nodes, edges = tokens.from_node_strings(rows, ["A", "N", "R"])
    assert nodes.exceptAll(g.nodes.select("graph_id", "node_id", "label")).count() == 0 and nodes.count() == g.nodes.count()
    assert edges.select("graph_id", "src", "dst").exceptAll(g.edges.select("graph_id", "src", "dst")).count() == 0 and edges.count() == g.edges.count()


def test_work_queue(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"id": k, "arch": "x" * k, "at": "2024-01-01T00:00:00"}) for k in (1, 2, 2)))
    seen = []
    q = queue.run(queue.scored(queue.items(spark, str(folder)), F.length("arch").cast("double")), str(tmp_path / "out"), str(tmp_path / "state"), lambda df, n: seen.append(df.count()))
    q.awaitTermination()
    got = queue.results(spark, str(tmp_path / "out"), spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert sorted((r.id, r.score) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, None)] and sum(seen) == 2


def test_activity_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "ev"))
    q = queue.activity(stream, "1 day").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("n")).first()[0] == src.count()


def test_union_of_collections(spark):
    d = "/root/testdata/sf0.001"
    a, b = views.conversation_graphs(spark, d), views.event_graphs(spark, d)
    u = views.union([a, b])
    assert u.nodes.count() == a.nodes.count() + b.nodes.count() and u.nodes.select("graph_id").distinct().count() == a.nodes.select("graph_id").distinct().count() + b.nodes.select("graph_id").distinct().count()
