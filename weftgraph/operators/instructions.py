"""What the surroundings of matches say about embedding instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut, kept
from weftgraph.operators.matching import packed
from weftgraph.operators.shapes import small
from weftgraph.sources.views import Graphs


def surroundings(g: Graphs, isms: DataFrame) -> DataFrame:
    """graph_id, ism_id, y, mu, pos, d, q: edges between matches(graph_id, ism_id, nodes) and neighbours outside.

    pos is the place in the match, d the edge's direction from it, mu the neighbour's label.
    """
    inside = lambda n: F.array_contains("nodes", n)
    crossing = F.filter("es", lambda e: inside(e["src"]) != inside(e["dst"]))
    seen = F.transform(
        crossing,
        lambda e: F.struct(
            F.when(inside(e["src"]), e["dst"]).otherwise(e["src"]).alias("y"),
            (F.array_position("nodes", F.when(inside(e["src"]), e["src"]).otherwise(e["dst"])) - 1).cast("int").alias("pos"),
            F.when(inside(e["src"]), "out").otherwise("in").alias("d"),
            e["label"].alias("q"),
        ),
    )
    # matches and their graphs are partitioned alike, so this join moves nothing that isn't moved already
    rows = isms.join(packed(g), "graph_id").select("graph_id", "ism_id", "labels", F.explode(seen).alias("e"))
    return rows.select("graph_id", "ism_id", F.col("e.y").alias("y"), F.element_at("labels", F.col("e.y")).alias("mu"), F.col("e.pos").alias("pos"), F.col("e.d").alias("d"), F.col("e.q").alias("q")).distinct()


def classes(around: DataFrame) -> DataFrame:
    """graph_id, ism_id, y, mu, signature, class: neighbours that are joined to the match alike share a class, numbered from 1."""
    signature = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pos", "d", "q"))), ",")
    s = around.groupBy("graph_id", "ism_id", "y", "mu").agg(signature.alias("signature"))
    return s.withColumn("class", F.dense_rank().over(W.partitionBy("graph_id", "ism_id").orderBy("mu", "signature")))


def inset(around: DataFrame) -> DataFrame:
    """graph_id, ism_id, mu, q, pos, d: instructions that a match needs, one for each kind of edge to a neighbour."""
    return around.select("graph_id", "ism_id", "mu", "q", "pos", "d").distinct()


def outset(around: DataFrame, size: int) -> DataFrame:
    """graph_id, ism_id, mu, pos, d: instructions that a match forbids, as a neighbour of that label has no such edge."""
    near = around.select("graph_id", "ism_id", "y", "mu").distinct()
    all_ = near.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos")).select("*", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("d"))
    return all_.join(around.select("graph_id", "ism_id", "y", "pos", "d"), ["graph_id", "ism_id", "y", "pos", "d"], "left_anti").select("graph_id", "ism_id", "mu", "pos", "d").distinct()


def realisations(g: Graphs, isms: DataFrame, size: int, black: str = "black", most: int = 8) -> DataFrame:
    """graph_id, ism_id, dir_id, ins, outs: each way to choose a direction for the new edge to each class of neighbours.

    An instruction is the string mu|p|q|pos|d|d2. Choices whose ins and outs
    meet are left out. A match without neighbours has one choice, which needs and
    forbids nothing. Choices are 2 to the power of the classes, each one given; matches
    of more than most classes are dealt out by their choices first, so that no task
    makes all of one. From 62 classes on a match has more choices than rows can be
    numbered by, and raises. What a match gives follows from its kinds of neighbours, so each set of kinds is worked on once.
    """
    match = ["graph_id", "ism_id"]
    near = surroundings(g, isms).groupBy(*match, "y", "mu").agg(F.array_sort(F.collect_set(F.struct("pos", "d", "q"))).alias("own"))
    kinds = near.groupBy(*match).agg(F.array_sort(F.collect_set(F.struct("mu", "own"))).alias("kinds"))
    of = isms.select(*match).distinct().join(kinds, match, "left").withColumn("kinds", F.coalesce("kinds", F.array().cast(kinds.schema["kinds"].dataType)))
    of = kept(of)
    firsts = cut(of.groupBy("kinds").agg(F.min(F.struct(*match)).alias("m")).select("kinds", "m.*"))
    around = firsts.select(*match, F.posexplode("kinds").alias("y", "k")).select(*match, "y", F.col("k.mu").alias("mu"), F.inline("k.own"))
    made = _realised(cut(around), firsts.select(*match), size, black, most)
    return of.join(small(cut(firsts.join(made, match).drop(*match))), "kinds").select(*match, "dir_id", "ins", "outs")


def _realised(around: DataFrame, isms: DataFrame, size: int, black: str, most: int) -> DataFrame:
    """realisations() of matches(graph_id, ism_id) with those surroundings."""
    cls = classes(around).select("graph_id", "ism_id", "y", "class")
    known = cls.groupBy("graph_id", "ism_id").agg(F.max("class").alias("n"))
    count = isms.select("graph_id", "ism_id").distinct().join(known, ["graph_id", "ism_id"], "left").fillna(0, ["n"])
    count = count.withColumn("n", F.when(F.col("n") < 62, F.col("n")).otherwise(F.raise_error(F.lit("a match with 62 or more classes of neighbours")).cast("int")))
    # high bits first: no array holds more than 2 to the power of most choices
    high = count.select("graph_id", "ism_id", "n")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, greatest(n - {most}, 0))") - 1))
    high = high.where(f"n <= {most}").withColumn("high", F.lit(0).cast("long")).unionByName(high.where(f"n > {most}").withColumn("high", spread).repartition("graph_id", "ism_id", "high"))
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, least(n, {most}))") - 1))
    pick = high.select("graph_id", "ism_id", "high", low.alias("low")).select("graph_id", "ism_id", F.expr(f"high * {1 << most} + low").alias("dir_id"))
    new = F.when(F.getbit("dir_id", F.col("class") - 1) == 1, "in").otherwise("out")
    chosen = cls.join(pick, ["graph_id", "ism_id"]).withColumn("d", new).drop("class")
    text = lambda *c: F.concat_ws("|", *c)
    have = chosen.join(around.select("graph_id", "ism_id", "y", "mu", "pos", F.col("d").alias("d2"), "q"), ["graph_id", "ism_id", "y"])
    ins = have.groupBy("graph_id", "ism_id", "dir_id").agg(F.array_sort(F.collect_set(text("mu", F.lit(black), "q", "pos", "d", "d2"))).alias("ins"))
    slots = chosen.join(around.select("graph_id", "ism_id", "y", "mu").distinct(), ["graph_id", "ism_id", "y"])
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos")).select("*", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("d2"))
    none = slots.join(around.select("graph_id", "ism_id", "y", "pos", F.col("d").alias("d2")), ["graph_id", "ism_id", "y", "pos", "d2"], "left_anti")
    outs = none.groupBy("graph_id", "ism_id", "dir_id").agg(F.array_sort(F.collect_set(text("mu", F.lit(black), F.lit(black), "pos", "d", "d2"))).alias("outs"))
    none_of = F.array().cast("array<string>")
    both = pick.join(ins, ["graph_id", "ism_id", "dir_id"], "left").join(outs, ["graph_id", "ism_id", "dir_id"], "left")
    both = both.withColumns({"ins": F.coalesce("ins", none_of), "outs": F.coalesce("outs", none_of)})
    return both.where(~F.arrays_overlap("ins", "outs"))


def bounds(realised: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lower, outs: the union of all ins and of all outs."""
    return realised.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ins")))).alias("lower"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("outs")))).alias("outs"))


def first_of_match(realised: DataFrame) -> DataFrame:
    """The first realisation of each match."""
    nth = F.row_number().over(W.partitionBy("graph_id", "ism_id").orderBy("dir_id"))
    return realised.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def signatures(realised: DataFrame) -> DataFrame:
    """sig_ins, sig_outs, n_graphs, n_isms: realisations as far as compatibility goes; there are few kinds."""
    return realised.groupBy(F.col("ins").alias("sig_ins"), F.col("outs").alias("sig_outs")).agg(F.countDistinct("graph_id").alias("n_graphs"), F.count("*").alias("n_isms"))


def conflicts(sigs: DataFrame) -> DataFrame:
    """a, b: pairs of signatures(sig, ins, outs) that no rule can serve, as one needs what the other forbids.

    An equi-join on the instruction makes pairs in conflict only; all others are compatible.
    """
    needs, bars = sigs.select(F.col("sig").alias("a"), F.explode("ins").alias("i")), sigs.select(F.col("sig").alias("b"), F.explode("outs").alias("i"))
    return needs.join(bars, "i").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def admitted(realised: DataFrame, embedding: list[str]) -> DataFrame:
    """Realisations that an existing rule serves: all they need is in its embedding, nothing they forbid is."""
    emb = F.array(*map(F.lit, embedding)) if embedding else F.array().cast("array<string>")
    return realised.where((F.size(F.array_except("ins", emb)) == 0) & ~F.arrays_overlap("outs", emb))


def upper(alphabet: list[str], black: str, size: int, outs: set[str]) -> set[str]:
    """All instructions over an alphabet and positions that aren't forbidden."""
    return {f"{mu}|{black}|{black}|{pos}|{d}|{e}" for mu in alphabet for pos in range(size) for d in ("in", "out") for e in ("in", "out")} - outs
