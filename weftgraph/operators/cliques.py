"""Compatible realisations: maximal cliques of the compatibility graph, found from its conflicts.

Two realisations are compatible if they are of different matches, lie in different graphs where
grammars are linear, don't touch, and neither needs an instruction that the other forbids. All
others conflict. The compatibility graph joins nearly all pairs, so it is never
made: a clique in it is an independent set of the conflicts, and each kind of conflict is
told by a key (a node, a graph, an instruction), over which least priorities are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut
from weftgraph.operators.instructions import conflicts
from weftgraph.sources.views import Graphs

KEYS = ["graph_id", "ism_id"]
NAMES = [*KEYS, "dir_id"]
#: Realisations of a graph that are taken one by one in its row, at most, where conflicts stay inside graphs.
LOCAL = 100


def local_conflicts(isms: DataFrame, g: Graphs) -> tuple[DataFrame, DataFrame]:
    """occupied(graph_id, ism_id, node_id) and reached: the nodes of matches(graph_id, ism_id, nodes), and those with their neighbours.

    Matches touch if one reaches a node that the other occupies.
    """
    occupied = isms.select(*KEYS, F.explode("nodes").alias("node_id")).distinct()
    both = g.edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to")).unionByName(g.edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("to"))).distinct()
    near = occupied.join(both, ["graph_id", "node_id"]).select(*KEYS, F.col("to").alias("node_id"))
    return occupied, occupied.unionByName(near).distinct()


def seeded(seed: int) -> Column:
    """A priority of realisations from a seed; no two are equal."""
    return F.struct(F.xxhash64(F.lit(seed), *NAMES).alias("h"), *NAMES)


def compatible(realised: DataFrame, isms: DataFrame, g: Graphs, linear: bool = True, priority: Column | None = None) -> DataFrame:
    """realised(graph_id, ism_id, dir_id, ins, outs): the rows of a maximal set without conflicts, with the round in which each was chosen.

    It is the set that takes realisations by priority, the least first, and leaves those
    in conflict with one taken; priorities must differ. All that are least among their conflicts are
    taken at once and what they bar goes, so with random priorities a few rounds, growing with the logarithm of the
    table, are enough. Realisations that forbid what they need serve no rule and are left out.
    The state is cut each round; pairs are never made. Where no conflict leaves a graph, graphs of LOCAL realisations at most
    are solved in a row each, with the same result.
    """
    rows = realised.where(~F.arrays_overlap("ins", "outs")).withColumn("p", seeded(0) if priority is None else priority)
    text = F.concat_ws("#", F.concat_ws(",", F.array_sort("ins")), F.concat_ws(",", F.array_sort("outs")))
    kinds = cut(rows.select("ins", "outs").distinct().select(F.md5(text).alias("sig"), "ins", "outs").groupBy("sig").agg(F.first("ins").alias("ins"), F.first("outs").alias("outs")))
    pairs = conflicts(kinds)
    barred = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if linear or not barred.isEmpty():
        return _in_rounds(rows.withColumn("sig", F.md5(text)), isms, g, linear, barred)
    # no conflict leaves a graph: those that fit a row are worked on there
    large = cut(rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL).select("graph_id"))
    if large.isEmpty():
        return _in_rows(rows, isms, g)
    small = _in_rows(rows.join(large, "graph_id", "left_anti"), isms.join(large, "graph_id", "left_anti"), Graphs(g.nodes, g.edges.join(large, "graph_id", "left_anti")))
    some = _in_rounds(rows.join(large, "graph_id", "left_semi").withColumn("sig", F.md5(text)), isms.join(large, "graph_id", "left_semi"), Graphs(g.nodes, g.edges.join(large, "graph_id", "left_semi")), linear, barred)
    return small.unionByName(some)


def _in_rows(rows: DataFrame, isms: DataFrame, g: Graphs) -> DataFrame:
    """compatible() where conflicts stay in graphs, none of which has many realisations: a row for each graph, in which they are taken one by one."""
    real = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("p", "ism_id", "dir_id", "ins", "outs"))).alias("real"))
    at = isms.groupBy("graph_id").agg(F.collect_list(F.struct("ism_id", "nodes")).alias("at"))
    edges = g.edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("es"))
    packs = real.join(at, "graph_id").join(edges, "graph_id", "left").withColumn("es", F.coalesce("es", F.array().cast(edges.schema["es"].dataType)))
    inside = lambda nodes, n: F.array_contains(nodes, n)
    near = lambda nodes: F.concat(F.transform(F.filter("es", lambda e: inside(nodes, e["src"])), lambda e: e["dst"]), F.transform(F.filter("es", lambda e: inside(nodes, e["dst"])), lambda e: e["src"]))
    at = F.transform("real", lambda m: F.struct(m["ism_id"].alias("ism_id"), m["dir_id"].alias("dir_id"), m["ins"].alias("ins"), m["outs"].alias("outs"), F.flatten(F.transform(F.filter("at", lambda x: x["ism_id"] == m["ism_id"]), lambda x: x["nodes"])).alias("nodes")))
    laid = packs.select("graph_id", "es", at.alias("real")).select("graph_id", F.transform("real", lambda m: m.withField("reach", F.concat(m["nodes"], near(m["nodes"])))).alias("real"))
    kind = laid.schema["real"].dataType.elementType
    state = "array<struct<m:" + kind.simpleString() + ",gone:boolean,round:int>>"

    def step(done: Column, m: Column) -> Column:
        # gone: barred by one taken in that round, the first that bars it; else taken in the round after the last in which an earlier rival went
        rivals = F.filter(done, lambda u: (u["m"]["ism_id"] == m["ism_id"]) | F.arrays_overlap(u["m"]["reach"], m["nodes"]))
        by = F.array_min(F.transform(F.filter(rivals, lambda u: ~u["gone"]), lambda u: u["round"]))
        after = F.coalesce(F.array_max(F.transform(rivals, lambda u: u["round"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(m.alias("m"), by.isNotNull().alias("gone"), F.coalesce(by, after).alias("round"))).cast(state))

    taken = F.filter(F.aggregate("real", F.array().cast(state), step), lambda u: ~u["gone"])
    return laid.select("graph_id", F.explode(taken).alias("u")).select("graph_id", "u.m.ism_id", "u.m.dir_id", "u.m.ins", "u.m.outs", "u.round")


def _in_rounds(rows: DataFrame, isms: DataFrame, g: Graphs, linear: bool, barred: DataFrame) -> DataFrame:
    """compatible() of rows with sig and p, in rounds over tables."""
    rows = cut(rows)
    occupied, reached = (cut(x) for x in local_conflicts(isms, g)) if not linear else (None, None)
    alive, taken, nth = cut(rows.select(*NAMES, "sig", "p")), None, 0
    while not alive.isEmpty():
        nth += 1
        if linear:
            least = alive.groupBy("graph_id").agg(F.min("p").alias("least"))
            first = alive.join(least, "graph_id").where(F.col("p") == F.col("least")).drop("least")
        else:
            at = alive.groupBy(*KEYS).agg(F.min("p").alias("p")).join(occupied, KEYS).groupBy("graph_id", "node_id").agg(F.min("p").alias("least"))
            least = reached.join(at, ["graph_id", "node_id"]).groupBy(*KEYS).agg(F.min("least").alias("least"))
            first = alive.join(least, KEYS).where(F.col("p") == F.col("least")).drop("least")
        by_kind = alive.groupBy(F.col("sig").alias("b")).agg(F.min("p").alias("rival"))
        rivals = barred.join(by_kind, "b").groupBy(F.col("a").alias("sig")).agg(F.min("rival").alias("rival"))
        new = cut(first.join(rivals, "sig", "left").where(F.col("rival").isNull() | (F.col("p") < F.col("rival"))).select(*NAMES, "sig", F.lit(nth).alias("round")))
        gone = new.select(F.col("sig").alias("a")).distinct().join(barred, "a").select(F.col("b").alias("sig")).distinct()
        alive = alive.join(gone, "sig", "left_anti")
        if linear:
            alive = alive.join(new.select("graph_id").distinct(), "graph_id", "left_anti")
        else:
            nodes = new.join(occupied, KEYS).select("graph_id", "node_id").distinct()
            alive = alive.join(reached.join(nodes, ["graph_id", "node_id"]).select(*KEYS).distinct(), KEYS, "left_anti")
        alive = cut(alive)
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        return rows.drop("sig", "p").withColumn("round", F.lit(0)).where("false")
    return rows.drop("sig", "p").join(taken.drop("sig"), NAMES)


def best(realised: DataFrame, isms: DataFrame, g: Graphs, linear: bool = True, tries: int = 3) -> DataFrame:
    """The largest of the sets that some seeds give; ties by the fewest instructions needed or forbidden, then by seed."""
    found = []
    for seed in range(tries):
        chosen = cut(compatible(realised, isms, g, linear, seeded(seed)))
        size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
        n, bound = chosen.agg(F.count("*"), size("ins") + size("outs")).first()
        found.append((-n, bound or 0, seed, chosen))
    return min(found, key=lambda x: x[:3])[3]


def embeddings(matches: dict[str, tuple[DataFrame, DataFrame, int]], g: Graphs, linear: bool = True) -> tuple[str, DataFrame] | None:
    """Of motifs by name, each with (realised, isms, number of terminals), the one whose set is worth most, and that set.

    Worth is the set's size times the terminals; the first of equal ones wins, none if all are empty.
    """
    top = None
    for name, (realised, isms, terminals) in matches.items():
        chosen = cut(compatible(realised, isms, g, linear))
        worth = chosen.count() * terminals
        if worth and (top is None or worth > top[0]):
            top = (worth, name, chosen)
    return top and top[1:]
