"""Paths through the graphs of a collection as rows, and what amplifier circuits need of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.circuits import CODES, VALUE
from weftgraph.operators.shapes import Shapes, named, shaped
from weftgraph.operators.traversal import closure
from weftgraph.sources.views import Graphs


def _ends(g: Graphs, source: str, sink: str) -> DataFrame:
    """graph_id, first, last: the least node of either label; null where there is none."""
    least = lambda x: F.min(F.when(F.col("label") == x, F.col("node_id")))
    return g.nodes.groupBy("graph_id").agg(least(source).alias("first"), least(sink).alias("last"))


def _pairs(g: Graphs) -> DataFrame:
    return g.edges.select("graph_id", "src", "dst").distinct()


def hops(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """graph_id, node_id, level: the fewest edges from one of starts(graph_id, node_id); nodes out of reach give no row."""
    step = cut(pairs.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("next")))
    front, seen, level = cut(starts.distinct().withColumn("level", F.lit(0))), None, 0
    while not front.isEmpty():
        level += 1
        seen = front if seen is None else seen.unionByName(front)
        reached = front.join(step, ["graph_id", "node_id"]).select("graph_id", F.col("next").alias("node_id")).distinct()
        front = cut(reached.join(seen, ["graph_id", "node_id"], "left_anti").withColumn("level", F.lit(level)))
    return front if seen is None else seen


def simple_paths(g: Graphs, source: str, sink: str) -> DataFrame:
    """graph_id, path: every path without a repeated node from the source to the sink. As many as there are; main_paths() keeps few."""
    s = shaped(g, _kinds([], [source, sink]), black=True)
    return s.rows(_grown(s.g, source, sink, None)).select("graph_id", _own("path").alias("path"))


def path_counts(g: Graphs, source: str, sink: str) -> DataFrame:
    """graph_id, n_paths, longest: how many simple paths there are from the source to the sink, and the nodes of the longest; no row without a path."""
    s = shaped(g, _kinds([], [source, sink]), black=True)
    counts = _grown(s.g, source, sink, None).groupBy("graph_id").agg(F.count("*").alias("n_paths"), F.max(F.size("path")).alias("longest"))
    return s.rows(counts).select("graph_id", "n_paths", "longest")


def _kinds(parts: list[str], whole: list[str]) -> Column:
    """What the paths read of a label: itself if it is one of whole, else the first of parts that it holds; "\0" for all others."""
    kind = F.when(F.col("label").isin(whole), F.col("label"))
    for x in parts:
        kind = kind.when(F.col("label").contains(x), x + "\0")  # equals none of whole
    return kind.otherwise("\0")


def _own(path: str) -> Column:
    """A path of places as one of nodes."""
    ids = F.col("ids")
    return F.transform(path, lambda p: F.get(ids, p - 1))


def main_paths(g: Graphs, source: str = "input", sink: str = "output", part: str = "gm") -> DataFrame:
    """graph_id, path, stages: the path with the most cells whose label holds part, the shortest of those, the least of those.

    Every graph gives a row; one without a path has an empty path and no stages.
    Partial paths grow by one edge a round. Of those that end in the same node and bar the
    same nodes from what may follow, only the best goes on: whatever completes
    one completes the other and adds the same to both. Where no cycle is ahead nothing is
    barred, so an acyclic graph keeps one partial path a node and round.
    """
    s = shaped(g, _kinds([part], [source, sink]), black=True)
    return s.rows(_main(s.g, source, sink, part)).select("graph_id", _own("path").alias("path"), "stages")


def _main(g: Graphs, source: str, sink: str, part: str) -> DataFrame:
    best = _grown(g, source, sink, part).groupBy("graph_id").agg(F.min(F.struct("rate", "path")).alias("b"))
    none = F.slice(F.array(F.lit(0).cast(g.nodes.schema["node_id"].dataType)), 1, 0)
    return g.nodes.select("graph_id").distinct().join(best, "graph_id", "left").select("graph_id", F.coalesce("b.path", none).alias("path"), F.coalesce(-F.col("b.rate.minus"), F.lit(0)).cast("long").alias("stages"))


def _grown(g: Graphs, source: str, sink: str, part: str | None) -> DataFrame:
    """Paths from source to sink; with part, its rate (minus the cells with it, nodes) and, by graph and round, only paths worth it."""
    ends, pairs = cut(_ends(g, source, sink)), cut(_pairs(g))
    reach = closure(pairs)
    aim = ends.where("last IS NOT NULL").select("graph_id", F.col("last").alias("dst"))
    useful = cut(reach.join(aim, ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node_id")).unionByName(aim.withColumnRenamed("dst", "node_id")).distinct())
    ahead = reach.join(useful.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("to")).agg(F.collect_set("dst").alias("ahead"))
    hit = F.coalesce(F.col("label").contains(part or ""), F.lit(False)).cast("int")
    cells = g.nodes.select("graph_id", F.col("node_id").alias("to"), hit.alias("hit")).join(useful.withColumnRenamed("node_id", "to"), ["graph_id", "to"]).join(ahead, ["graph_id", "to"], "left")
    step = cut(pairs.select("graph_id", F.col("src").alias("at"), F.col("dst").alias("to")).join(cells, ["graph_id", "to"]).join(ends.select("graph_id", "last"), "graph_id"))
    front = ends.where("last IS NOT NULL").select("graph_id", F.col("first").alias("to")).join(cells, ["graph_id", "to"])
    front = cut(front.select("graph_id", F.col("to").alias("at"), F.struct((-F.col("hit")).alias("minus"), F.lit(1).alias("n")).alias("rate"), F.array("to").alias("path")))
    done = None
    while True:
        longer = front.join(step, ["graph_id", "at"]).where(~F.array_contains("path", F.col("to"))).select(
            "graph_id", "to", F.col("to").eqNullSafe(F.col("last")).alias("ends"), F.struct((F.col("rate.minus") - F.col("hit")).alias("minus"), (F.col("rate.n") + 1).alias("n")).alias("rate"),
            F.array_append("path", F.col("to")).alias("path"), F.array_sort(F.array_intersect("path", F.coalesce("ahead", F.slice("path", 1, 0)))).alias("barred"),
        )
        if part is not None:
            # behind the sink nothing follows, so nothing is barred there
            barred = F.when(F.col("ends"), F.slice("barred", 1, 0)).otherwise(F.col("barred"))
            longer = longer.withColumn("barred", barred).groupBy("graph_id", "to", "ends", "barred").agg(F.min(F.struct("rate", "path")).alias("b")).select("graph_id", "to", "ends", "b.rate", "b.path")
        longer = cut(longer.select("graph_id", "to", "ends", "rate", "path"))
        arrived = longer.where("ends").select("graph_id", "rate", "path")
        done = arrived if done is None else done.unionByName(arrived)
        front = longer.where("NOT ends").select("graph_id", F.col("to").alias("at"), "rate", "path")
        if front.isEmpty():
            return done if part is not None else done.select("graph_id", "path")


def numbered(g: Graphs, main: DataFrame | None = None) -> DataFrame:
    """graph_id, node_id, number, stages, problem: 0 the input, 1 the output, then the main path, then the rest.

    number is null, and problem says why, unless there are two or three stages, all nodes
    are on the main path or lead into it, and only gain cells are on it.
    """
    if main is not None:
        return _numbered(g, cut(main))
    s, numbers = _shape_numbers(g)
    return s.spread(numbers).select("graph_id", named("node_id").alias("node_id"), "number", "stages", "problem")


def _shape_numbers(g: Graphs) -> tuple[Shapes, DataFrame]:
    """The shapes of circuits by what the main path reads of labels, and the numbers of their places."""
    s = shaped(g, _kinds(["gm"], ["input", "output"]), black=True)
    return s, _numbered(s.g, cut(_main(s.g, "input", "output", "gm")))


def _numbered(g: Graphs, main: DataFrame) -> DataFrame:
    on = main.select("graph_id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "node_id"))
    into = _pairs(g).join(on.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node_id"))
    near = into.unionByName(on.select("graph_id", "node_id")).distinct().groupBy("graph_id").agg(F.count("*").alias("near"))
    size = g.nodes.groupBy("graph_id").agg(F.count("*").alias("size"))
    problem = (
        F.when(~F.col("stages").isin(2, 3), F.concat(F.col("stages").cast("string"), F.lit(" stages")))
        .when(F.col("near") != F.col("size"), "a node neither is on the main path nor leads into it")
        .when(F.size("path") != F.col("stages") + 2, "another cell than a gain cell is on the main path")
    )
    state = main.join(size, "graph_id").join(near, "graph_id", "left").select("graph_id", "stages", F.size("path").alias("length"), problem.alias("problem"))
    place = F.when(F.col("pos") == 0, 0).when(F.col("pos") == F.col("n") - 1, 1).otherwise(F.col("pos") + 1)
    placed = g.nodes.select("graph_id", "node_id").join(on.select("graph_id", "node_id", place.alias("place")), ["graph_id", "node_id"], "left").join(state, "graph_id")
    nth = F.row_number().over(W.partitionBy("graph_id", F.col("place").isNull()).orderBy("node_id"))
    number = F.when(F.col("problem").isNull(), F.coalesce("place", F.col("length") + nth - 1))
    return placed.select("graph_id", "node_id", number.cast("long").alias("number"), "stages", "problem")


def bypassed(g: Graphs) -> DataFrame:
    """graph_id, bypassed: whether each inverting gain cell on a shortest path has an R or C beside it.

    One that a predecessor of the cell feeds and that shares a successor with it. False for graphs without a path.
    """
    x = F.col("label")
    kind = F.when(x.isin("input", "output"), x).when(x.isin("-gm-", "+gm-"), "-gm-").when(x.isin("R", "C"), "R").otherwise("")
    s = shaped(g, kind, black=True)
    return s.rows(_bypassed(s.g)).select("graph_id", "bypassed")


def _bypassed(g: Graphs) -> DataFrame:
    ends, pairs = cut(_ends(g, "input", "output").where("first IS NOT NULL AND last IS NOT NULL")), cut(_pairs(g))
    there = hops(pairs, ends.select("graph_id", F.col("first").alias("node_id")))
    back = hops(pairs.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src")), ends.select("graph_id", F.col("last").alias("node_id")))
    whole = there.join(ends.select("graph_id", F.col("last").alias("node_id")), ["graph_id", "node_id"]).select("graph_id", F.col("level").alias("whole"))
    on = there.join(back.withColumnRenamed("level", "rest"), ["graph_id", "node_id"]).join(whole, "graph_id").where("level + rest = whole")
    cells = cut(on.join(g.nodes.where(F.col("label").isin("-gm-", "+gm-")), ["graph_id", "node_id"]).select("graph_id", F.col("node_id").alias("cell")))
    passive = g.nodes.where(F.col("label").isin("R", "C")).select("graph_id", F.col("node_id").alias("beside"))
    fed = cells.join(pairs.select("graph_id", F.col("src").alias("p"), F.col("dst").alias("cell")), ["graph_id", "cell"]).join(pairs.select("graph_id", F.col("src").alias("p"), F.col("dst").alias("beside")), ["graph_id", "p"])
    fed = fed.join(passive, ["graph_id", "beside"]).select("graph_id", "cell", "beside").distinct()
    after = lambda x: pairs.select("graph_id", F.col("src").alias(x), F.col("dst").alias("after"))
    met = fed.join(after("cell"), ["graph_id", "cell"]).join(after("beside"), ["graph_id", "beside", "after"]).select("graph_id", "cell").distinct()
    open_ = cells.join(met, ["graph_id", "cell"], "left_anti").select("graph_id").distinct().withColumn("open", F.lit(True))
    return g.nodes.select("graph_id").distinct().join(whole, "graph_id", "left").join(open_, "graph_id", "left").select("graph_id", (F.col("whole").isNotNull() & F.col("open").isNull()).alias("bypassed"))


def texts(g: Graphs, numbers: DataFrame | None = None, value: str = VALUE) -> DataFrame:
    """graph_id, text, problem: a header with the numbers of nodes (twice) and stages, then a line a node.

    A line has the cell's code, its number twice, its predecessors and a value for each of them. text is null where
    a circuit has no numbers, or a cell with neither a code nor a place at an end.
    """
    code: Column = F.create_map(*[F.lit(x) for x in chain(*CODES.items())])
    if numbers is None:
        s, found = _shape_numbers(g)
        found = cut(found)
        good = _after_numbers(s.g, found)
        cells = good.groupBy("graph_id").agg(F.first("stages").alias("stages"), F.array_sort(F.collect_list(F.struct("number", "node_id", "pred"))).alias("cells_"))
        of = s.rows(found.groupBy("graph_id").agg(F.min("problem").alias("problem")).join(cells, "graph_id", "left"))
        # a cell of the shape has its own label where the shape lists its place
        at = lambda p: F.get("labels", (F.array_position(F.col("cells.place"), p) - 1).cast("int"))
        lines = F.transform("cells_", lambda c: F.struct(c["number"].alias("number"), _line(F.try_element_at(code, at(c["node_id"])), c["number"], c["pred"], value).alias("line")))
        rows = of.select("graph_id", "problem", "stages", lines.alias("lines"))
    else:
        numbers = cut(numbers)
        labels = g.nodes.select("graph_id", "node_id", F.try_element_at(code, F.col("label")).alias("code"))
        cells = _after_numbers(g, numbers).join(labels, ["graph_id", "node_id"]).select("graph_id", "number", "stages", _line(F.col("code"), F.col("number"), F.col("pred"), value).alias("line"))
        cells = cells.groupBy("graph_id").agg(F.first("stages").alias("stages"), F.array_sort(F.collect_list(F.struct("number", "line"))).alias("lines"))
        rows = numbers.groupBy("graph_id").agg(F.min("problem").alias("problem")).join(cells, "graph_id", "left")
    size = F.size("lines").cast("string")
    text = F.concat(size, F.lit(" "), size, F.lit(" "), F.col("stages").cast("string"), F.lit("\n"), F.array_join(F.col("lines.line"), "\n"), F.lit("\n"))
    made = rows.withColumn("text", F.when(F.forall("lines", lambda x: x["line"].isNotNull()), text))
    return made.select("graph_id", "text", F.coalesce("problem", F.when(F.col("text").isNull(), F.lit("a cell without a code"))).alias("problem"))


def _after_numbers(g: Graphs, numbers: DataFrame) -> DataFrame:
    """graph_id, node_id, number, stages, pred: the numbered nodes, and the numbers of those before each, sorted."""
    good = numbers.where("number IS NOT NULL").select("graph_id", "node_id", "number", "stages")
    of = lambda x, y: good.select("graph_id", F.col("node_id").alias(x), F.col("number").alias(y))
    before = _pairs(g).join(of("src", "before"), ["graph_id", "src"]).join(of("dst", "number"), ["graph_id", "dst"]).groupBy("graph_id", "number").agg(F.array_sort(F.collect_list("before")).alias("before"))
    return good.join(before, ["graph_id", "number"], "left").withColumn("pred", F.coalesce("before", F.slice(F.array(F.lit(0).cast("long")), 1, 0))).drop("before")


def _line(code: Column, number: Column, pred: Column, value: str) -> Column:
    """A cell's line of the text form; null without a code."""
    values = F.concat(F.array(F.lit("-1")), F.array_repeat(F.lit(value), F.size(pred)), F.array(F.lit("-1")))
    tail = F.when(number == 0, F.array(F.lit("1 8 0 1"))).when(number == 1, F.array(F.lit("1 9 0 1"))).otherwise(values)
    head = F.array(code.cast("string"), number.cast("string"), number.cast("string"), F.size(pred).cast("string"))
    return F.when(code.isNotNull(), F.array_join(F.concat(head, pred.cast("array<string>"), tail), " "))
