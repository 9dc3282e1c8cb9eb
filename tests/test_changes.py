import random
import time

from weftgraph.operators import ego, incremental, traversal
from weftgraph.sources.views import Graphs
from weftgraph.streaming.watchdog import Watchdog

EDGE = "graph_id long, src long, dst long"


def pairs(df):
    return sorted((r.graph_id, r.src, r.dst) for r in df.select("graph_id", "src", "dst").collect())


def test_maintained_equals_made_anew(spark):
    """With cycles: edges go and come, and the closure is that of what is there then."""
    rng = random.Random(1)
    old = {(g, rng.randrange(7), rng.randrange(7)) for g in range(6) for _ in range(9)}
    gone = set(rng.sample(sorted(old), 12))
    added = {(g, rng.randrange(7), rng.randrange(7)) for g in range(4) for _ in range(2)} - old
    frame = lambda x: spark.createDataFrame(sorted(x), EDGE)
    now = (old - gone) | added
    closed = traversal.closure(frame(old))
    assert pairs(incremental.maintained(closed, frame(now), frame(added), frame(gone))) == pairs(traversal.closure(frame(now)))


def test_images_keep_edges(spark):
    rng = random.Random(2)
    ns, es = [], []
    for g in range(30):
        base = random.Random(g % 6)
        size = base.randrange(2, 6)
        labels = [base.choice("AB") for _ in range(size)]
        edges = [(a, b) for a in range(size) for b in range(size) if a != b and base.random() < 0.4]
        p = rng.sample(range(size), size)
        ns += [(g, p[k], labels[k]) for k in range(size)]
        es += [(g, p[a], p[b], "x") for a, b in edges]
    graph = Graphs(spark.createDataFrame(ns, "graph_id long, node_id long, label string"), spark.createDataFrame(es, EDGE + ", label string"))
    image = {(r.graph_id, r.node_id): (r.first, r.image) for r in traversal.aligned(traversal.canonical_places(graph)).collect()}
    label, edges = {(g, n): x for g, n, x in ns}, {(g, a, b) for g, a, b, _ in es}
    assert len(image) == len(ns) and len({f for f, _ in image.values()}) <= 6
    assert all(label[k] == label[v] for k, v in image.items())
    assert all((image[g, a][0], image[g, a][1], image[g, b][1]) in edges for g, a, b in edges)


def test_neighbourhoods_of_a_star_and_a_path(spark):
    es = [(0, 0, k, "x") for k in range(1, 5)] + [(1, k, k + 1, "x") for k in range(4)]
    ns = sorted({(g, n, "A") for g, a, b, _ in es for n in (a, b)}) + [(2, 0, "A")]
    graph = Graphs(spark.createDataFrame(ns, "graph_id long, node_id long, label string"), spark.createDataFrame(es, EDGE + ", label string"))
    kind = {(r.graph_id, r.node_id): r.label for r in ego.relabelled(graph, 1).nodes.collect()}
    assert [kind[0, k] for k in range(5)] == ["0", "1", "1", "1", "1"]
    assert [kind[1, k] for k in range(5)] == ["0", "1", "1", "1", "0"] and kind[2, 0] == "0"
    two = {(r.graph_id, r.node_id): r.label for r in ego.relabelled(graph, 2).nodes.collect()}
    assert [two[1, k] for k in range(5)] == ["0", "1", "2", "1", "0"]


def test_a_stalled_stream_is_stopped_and_a_live_one_is_not(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stalled = spark.readStream.schema("value string").text(str(tmp_path / "empty"))
    live = spark.readStream.format("rate").option("rowsPerSecond", 20).load()
    start = lambda df, k: df.writeStream.format("noop").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / k)).start()
    with Watchdog(spark, seconds=15, poll=1) as dog:
        a, b = start(stalled, "a"), start(live, "b")
        began = time.monotonic()
        while a.isActive and time.monotonic() - began < 60:
            time.sleep(1)
        time.sleep(3)
        assert not a.isActive and b.isActive and dog.stopped == [str(a.id)]
        b.stop()
