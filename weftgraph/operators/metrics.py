"""Scores of collections, models and grammars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def novel(found: DataFrame, known: DataFrame, key: str = "form") -> DataFrame:
    """Rows of found whose key known doesn't hold. Null keys are novel."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def uniqueness(found: DataFrame, key: str = "form") -> DataFrame:
    """found with is_unique: no other row has the key. Counted by key first, so that a hot key is one row in the join."""
    count = found.groupBy(key).agg(F.count("*").alias("_n"))
    return found.join(count, found[key].eqNullSafe(count[key]), "left").drop(count[key]).withColumn("is_unique", (F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


def evaluate(found: DataFrame, known: DataFrame, key: str = "form", valid: str = "valid") -> DataFrame:
    """n, valid, novel, unique: shares over all rows; an invalid row is neither novel nor unique.

    One pass of sums by key: a key is unique if it comes once, and novel if known lacks it.
    """
    ok = found.where(F.col(valid)).groupBy(key).agg(F.count("*").alias("n"))
    ok = ok.join(known.select(key, F.lit(True).alias("old")).distinct(), key, "left")
    sums = ok.agg(F.sum("n").alias("v"), F.sum(F.when(F.col("old").isNull(), F.col("n"))).alias("w"), F.count_if(F.col("n") == 1).alias("u"))
    total = found.agg(F.count("*").alias("n"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n")
    return total.join(sums, F.lit(True)).select("n", share("v").alias("valid"), share("w").alias("novel"), share("u").alias("unique"))


def standardised(rows: DataFrame, order: str, value: str, train: float = 0.9) -> DataFrame:
    """rows with is_train and z: values negated and scaled by mean and population deviation of the first rows.

    is_train marks the first floor(n x train) rows in the order of an integer
    column; ranks come from counts by range of the order, not from one sorted task.
    """
    n = rows.count()
    limit = int(n * train)
    cut = nth(rows, order, limit) if limit else None
    marked = rows.withColumn("is_train", F.lit(False) if cut is None else F.col(order) <= F.lit(cut))
    s = marked.where("is_train").agg(F.avg(-F.col(value)).alias("m"), F.stddev_pop(value).alias("d")).first()
    return marked.withColumn("z", (-F.col(value) - F.lit(s["m"])) / F.lit(s["d"]))


def nth(rows: DataFrame, order: str, rank: int, ranges: int = 4096) -> int | None:
    """The value of rank (from 1) of an integer column, exactly: counts by range, and the range that holds the rank is divided again. The last one if there are fewer."""
    keys = rows.select(F.col(order).cast("decimal(20,0)").alias("k")).where("k IS NOT NULL")
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return None
    low, high = int(low), int(high)
    while low < high:
        width = -(-(high - low + 1) // ranges)
        counts = keys.where(f"k BETWEEN {low} AND {high}").groupBy(F.expr(f"(k - ({low})) div {width}").alias("r")).agg(F.count("*").alias("n")).collect()
        for r, n in sorted(map(tuple, counts)):
            if rank <= n:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            rank -= n
        else:
            return high
    return low


def fit_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """rmse, correlation and r2 of guesses."""
    error = (F.col(truth) - F.col(guess)) ** 2
    return rows.agg(F.sqrt(F.avg(error)).alias("rmse"), F.corr(truth, guess).alias("correlation"), (1 - F.sum(error) / (F.var_pop(truth) * F.count(truth))).alias("r2"))


def log_likelihood(rows: DataFrame, error: str, scale: str) -> DataFrame:
    """Mean log-density of errors under normals of the given deviations."""
    z = F.col(error) / F.col(scale)
    return rows.agg(F.avg(-0.5 * z * z - F.log(F.col(scale)) - 0.5 * F.log(F.lit(2 * 3.141592653589793))).alias("log_likelihood"))


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_square_distance(vectors: DataFrame, vector: str) -> DataFrame:
    """n_pairs and mean squared distance over all pairs, from sums of parts: no pairs are made."""
    parts = vectors.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    n = vectors.agg(F.count("*").alias("n"))
    sums = parts.agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.join(n, F.lit(True)).select(pairs.cast("long").alias("n_pairs"), ((F.col("n") * F.col("q") - F.col("ss")) / pairs).alias("mean_square_distance"))


def mean_distance(vectors: DataFrame, group: str, order: str, vector: str, block: int = 512) -> DataFrame:
    """group, n_pairs, mean_distance over the pairs of each group: all of them, whatever the group's size.

    A group is dealt into blocks of about so many vectors by a hash of their order,
    and each pair of blocks is a tile that sums its own distances, so no task holds
    a group and no pair becomes a row. Vectors with the same order aren't paired;
    pairs of missing or unequally long vectors count, but have no distance.
    """
    one = vectors.select(F.col(group).alias("g"), F.col(order).alias("k"), F.col(vector).cast("array<double>").alias("x")).where("g IS NOT NULL AND k IS NOT NULL")
    one = one.withColumn("x", F.when(~F.exists("x", lambda e: e.isNull()), F.col("x")))
    large = one.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).where("n > 1")  # at most a row for each block
    own = one.join(F.broadcast(large), "g", "left").fillna(1, ["n"]).withColumn("at", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("g", "k", "x", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"))

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["at"] == key[1]], pdf[pdf["at"] == key[2]]
        same = key[1] == key[2]
        times = a["k"].value_counts()
        n = (len(a) ** 2 - int((times**2).sum())) // 2 if same else len(a) * len(b)
        total, held = 0.0, 0
        size = lambda p: p["x"].map(lambda x: -1 if x is None else len(x))
        for d in set(size(a)) & set(size(b)) - {-1}:
            u, v = a[size(a) == d], b[size(b) == d]
            x, y = (np.array(list(p["x"]), float).reshape(len(p), d) for p in (u, v))
            i, j = u["k"].to_numpy(), v["k"].to_numpy()
            for k in range(len(x)):
                far = np.sqrt(((y - x[k]) ** 2).sum(axis=1))
                if same:
                    far = far[j > i[k]]
                total, held = total + float(far.sum()), held + len(far)
        return pd.DataFrame({"g": [key[0]], "n": [n], "held": [held], "total": [total]})

    kind = one.schema["g"].dataType.simpleString()
    sums = dealt.repartition("g", "lo", "hi").groupBy("g", "lo", "hi").applyInPandas(tile, f"g {kind}, n long, held long, total double").groupBy("g").agg(F.sum("n").alias("n_pairs"), F.sum("held").alias("held"), F.sum("total").alias("total"))
    return sums.where("n_pairs > 0").select(F.col("g").alias(group), "n_pairs", F.when(F.col("held") > 0, F.col("total") / F.col("held")).alias("mean_distance"))


def rule_usage(used: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, n_used: how often each of rules(rule_id) is in used(rule_id), 0 included."""
    return rules.select("rule_id").join(used.groupBy("rule_id").agg(F.count("*").alias("n_used")), "rule_id", "left").fillna(0, ["n_used"])


def overlaps(sets: DataFrame, item: str, owner: str, key: str) -> DataFrame:
    """item, a, b, shared, iou: multisets of key by owner, compared inside each item, pairs a < b that share a key.

    The intersection takes the smaller count of each key, so a match counts once; pairs without a common key have 0 and aren't made.
    """
    n = sets.groupBy(item, owner, key).agg(F.count("*").alias("n"))
    size = n.groupBy(item, owner).agg(F.sum("n").alias("size"))
    a, b = (n.withColumnsRenamed({owner: o, "n": f"n_{o}"}) for o in ("a", "b"))
    shared = a.join(b, [item, key]).where("a < b").groupBy(item, "a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    sized = shared.join(size.withColumnsRenamed({owner: "a", "size": "size_a"}), [item, "a"]).join(size.withColumnsRenamed({owner: "b", "size": "size_b"}), [item, "b"])
    return sized.select(item, "a", "b", "shared", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("iou"))


def top_k(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with their rank."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def share_containing(graphs: DataFrame, hits: DataFrame) -> DataFrame:
    """n_graphs and the share of graphs(graph_id) that hits(graph_id) names."""
    marked = graphs.select("graph_id").distinct().join(hits.select("graph_id", F.lit(1.0).alias("hit")).distinct(), "graph_id", "left")
    return marked.agg(F.count("*").alias("n_graphs"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))


def equal_mass(vectors: DataFrame, id_col: str, vector: str, clusters: int, seed: int = 0) -> DataFrame:
    """One row of each of so many k-means clusters, by a seeded hash of its id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=clusters, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.min_by(id_col, F.struct(F.xxhash64(F.lit(seed), id_col), id_col)).alias(id_col))
