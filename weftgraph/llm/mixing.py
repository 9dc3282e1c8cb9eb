"""Mixing sources to target weights by hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from weftgraph.operators.checkpoints import cut

#: Bits of the hash that each level of histograms looks at; five levels reach the whole hash.
BITS, LEVELS = 13, 5
#: Sources whose thresholds are broadcast, at most; with more, they are joined by a shuffle in which each source has SALTS parts.
FEW, SALTS = 20_000, 64
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
ADDED = ("size", "source_size", "target", "taken")


def _joined(rows: DataFrame, table: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows, which have a hash h, beside the row of table that has their key."""
    if few:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _prefix(level: int) -> Column:
    """The first bits of the hash; rises with the hash as a signed number."""
    return F.shiftright("h", max(0, 64 - BITS * level))


def _hashable(f: StructField) -> Column:
    named = F.col("`" + f.name.replace("`", "``") + "`")
    return F.to_json(F.struct(named)) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else named


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target and taken (words the mix takes, repeats counted).

    Together the sources get share times all words, by weight; a target stops at
    most times its source's size and the excess goes to the others by weight. Each
    document is taken floor(target / size) times, and once more if its hash lies
    below the source's threshold.

    Thresholds: words by source and hash bucket are summed; where the running sum
    passes the budget, only that bucket is summed again by the next bits of the
    hash, and so on, so nothing is sorted. What is left to choose from in the end are
    rows of one hash, which hashes all columns: as many of them are taken as come
    nearest to the budget. Equal rows count once with their number from the start, so
    a row that a third of all repeat is no hot key, and it is taken in part. The
    sources' own table, a row each, is ordered in one task.

    A null text has no words; a null source is one of its own, after all others.
    Null ids and repeated ids are rows like others. Sources without words get a
    target of 0. Columns of docs named like the added ones are replaced; others may
    have any names. An empty table gives no rows.
    """
    docs = docs.drop(*({*ADDED} & {*docs.columns}))
    words = lambda text: F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    hashes = [F.xxhash64(F.lit(seed + k), *map(_hashable, docs.schema)) for k in range(2)]
    named = docs.select(F.struct("*").alias("row"), key.alias("key"), hashes[0].alias("h"), hashes[1].alias("g"))
    base = docs.select(key.alias("key"), hashes[0].alias("h"), words(F.col(text_col)).alias("size"))
    base = cut(base.groupBy("key", "h").agg(F.sum("size").alias("size")))

    sources = base.groupBy("key").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(W.orderBy(F.col("key") == "", "key")) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))).withColumn("stop", most * F.col("source_size"))
    every, upto = W.partitionBy(), W.orderBy(F.col("stop") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))
    rate = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # sources in the order in which they reach their stop: from the first that doesn't, all get the same rate
    level = sources.withColumn("rate", rate).withColumn("rate", F.min(F.when(F.col("rate") <= F.col("stop") / F.col("w"), F.struct(F.col("stop") / F.col("w"), "rate"))).over(every)["rate"])
    targets = level.select("key", "source_size", F.least("stop", F.coalesce(F.col("rate") * F.col("w"), F.col("stop"))).alias("target"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.withColumn("full", full).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))))
    few = targets.count() <= FEW

    edge = targets.select("key", "need")
    for k in range(1, LEVELS + 1):
        if k == 1:  # sums of all come before the needs are beside them
            sums = base.groupBy("key", _prefix(k).alias("prefix")).agg(F.sum("size").alias("s")).join(F.broadcast(edge) if few else edge, "key")
        else:
            inside = _joined(base.withColumn("up", _prefix(k - 1)), edge.withColumnRenamed("prefix", "up"), ["key", "up"], few)
            sums = inside.groupBy("key", "need", _prefix(k).alias("prefix")).agg(F.sum("size").alias("s"))
        run = W.partitionBy("key").orderBy("prefix")
        sums = sums.withColumn("before", F.sum("s").over(run) - F.col("s")).where(F.col("before") <= F.col("need"))
        # the last bucket that begins within the budget is the boundary
        edge = cut(sums.groupBy("key").agg(F.max(F.struct("prefix", (F.col("need") - F.col("before")).alias("need"))).alias("e")).select("key", "e.prefix", "e.need"))
    plan = cut(targets.select("key", "source_size", "target", "full").join(edge.withColumnRenamed("prefix", "limit"), "key"))

    placed = _joined(named, plan, ["key"], few)
    text = F.col("row")[text_col]
    apart = placed.where("h <> limit").withColumn("size", words(text)).select("row.*", "size", "source_size", "target", (F.col("size") * (F.col("full") + (F.col("h") < F.col("limit")).cast("long"))).alias("taken"))
    # rows at the boundary are equal ones: those of a task count as one, and the budget goes through them in order
    equal = placed.where("h = limit").groupBy("key", "g", F.spark_partition_id().alias("part")).agg(F.first(F.struct("row", "source_size", "target", "full", "need")).alias("e"), F.count("*").alias("n")).select("key", "g", "part", "n", "e.*")
    equal = equal.withColumn("size", words(text))
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(W.partitionBy("key").orderBy("g", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = F.when(F.col("size") > 0, F.floor((F.col("need") - before) / F.col("size") + 0.5)).otherwise(0)
    equal = equal.withColumn("more", more).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    equal = equal.select("row.*", "size", "source_size", "target", (F.col("size") * (F.col("full") + (F.col("nth") <= F.col("more")).cast("long"))).alias("taken"))
    return apart.unionByName(equal)
