"""Approximate nearest neighbours: inverted lists scanned by adaptive dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut

#: Vectors that the lists are fitted on, at most; lists, at most; vectors or queries that meet at once, at most.
SAMPLE, LISTS, TILE = 32_768, 2048, 4096


@dataclass
class Index:
    """Rotation, centres of lists, and the share of all vectors that a query looks at."""

    rotation: np.ndarray
    centres: np.ndarray
    share: float


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _stack(column) -> np.ndarray:
    return np.array(column.tolist(), float)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(x), 4096)])


def _valid(x: Column) -> Column:
    """Without nulls and non-finite parts, and not zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def fit(vectors: DataFrame, recall: float = 0.97, k: int = 5, seed: int = 3, id_col: str = "vec_id", vector_col: str = "v") -> Index | None:
    """An index fitted on at most SAMPLE vectors that a hash of the id chooses.

    The share that queries look at is the least at which sample queries find the
    asked-for share of their true neighbours in the sample. None without vectors.
    """
    n = vectors.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    got = vectors.where(part <= min(1.0, 1.5 * SAMPLE / n)).orderBy(F.xxhash64(id_col), id_col, vector_col).limit(SAMPLE).select(vector_col).toPandas()
    x = _unit(_stack(got[vector_col]))
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((x.shape[1],) * 2))[0]
    x = x @ rotation
    lists = max(1, min(LISTS, round(n**0.5), len(x) // 8))  # more lists at every size, up to what the sample can tell apart
    centres = x[random.choice(len(x), lists, replace=False)]
    for _ in range(6):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    at = _nearest(x, centres)
    ask = x[:: max(1, len(x) // 200)][:200]
    near = np.argsort(-(ask @ x.T), 1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(ask @ centres.T), 1, kind="stable")
    seen = np.take_along_axis(np.cumsum(np.bincount(at, minlength=lists)[order], 1), np.argsort(order, 1), 1)  # looked at when each list is done
    needs = np.sort((np.take_along_axis(seen, at[near], 1) / len(x)).ravel()) if near.size else np.ones(1)
    return Index(rotation, centres, float(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))]))


def _scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, block: int, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) whose squared distance is below the query's limit.

    Distances grow by blocks of the rotated dimensions. After each, a pair goes if
    its distance so far is too large for one below the limit: under a random
    rotation d of D dimensions hold d / D of the distance, up to a factor of
    (1 + doubt / sqrt(d))^2.
    """
    size = q.shape[1]
    first = q[:, :block], x[:, :block]
    so_far = (first[0] ** 2).sum(1)[:, None] + (first[1] ** 2).sum(1)[None] - 2 * first[0] @ first[1].T
    at = min(block, size)
    bound = lambda d: 1 + 1e-9 if d == size else d / size * (1 + doubt / np.sqrt(d)) ** 2
    a, b = np.nonzero(so_far <= limit[:, None] * bound(at) + 1e-9)
    so_far = so_far[a, b]
    while at < size and len(a):
        to = min(size, at + block)
        so_far = so_far + ((q[a, at:to] - x[b, at:to]) ** 2).sum(1)
        at = to
        stay = so_far <= limit[a] * bound(at) + 1e-9
        a, b, so_far = a[stay], b[stay], so_far[stay]
    return a, b


def search(vectors: DataFrame, queries: Column, k: int = 5, recall: float = 0.97, block: int = 16, doubt: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each row that the condition queries names.

    Every valid vector is in a list; a query looks at its nearest lists until they
    hold the index's share of all vectors, and more than k in any case. The
    nearest list gives it a first limit; in the others, tests on partial distances
    drop candidates early, and those left are scored exactly, in double precision
    on the original vectors. A query that has found fewer than k ids looks at all
    lists. Lists and their queries meet in tiles of bounded size, so that a vector
    that many ids share is spread over many tasks.

    Vectors that are null, zero, hold null or non-finite parts or lack an id take no
    part. Cosines compare vectors of one length: each is searched among those of its
    own, with an index for each length that queries have. Equal rows are one from
    the start. Rows that repeat an id count once; if their vectors differ, by the
    nearest. Ties go to smaller ids. Further columns are ignored; an empty table
    gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    out = None
    for size in sorted(r[0] for r in rows.where("asks").select(F.size("v")).distinct().collect()):
        part = _search(rows.where(F.size("v") == size).distinct(), k, recall, block, doubt)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(good: DataFrame, k: int, recall: float, block: int, doubt: float) -> DataFrame:
    """search() over distinct valid vectors of one length."""
    spark = good.sparkSession
    good = cut(good)
    shared = spark.sparkContext.broadcast(fit(good, recall, k))

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"list": (_unit(_stack(pdf.v)) @ index.rotation @ index.centres.T).argmax(1), "vec_id": pdf.vec_id, "v": pdf.v})

    listed = cut(good.mapInPandas(assign, "list int, vec_id long, v array<double>"))
    sizes = np.zeros(len(shared.value.centres), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list, LISTS at most
        sizes[r["list"]] = r["n"]
    total = int(sizes.sum())

    def probe(everywhere: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in it:
                if len(pdf):
                    order = np.argsort(-(_unit(_stack(pdf.v)) @ index.rotation @ index.centres.T), 1, kind="stable")
                    before = np.cumsum(sizes[order], 1) - sizes[order]
                    enough = total if everywhere else max(index.share * total, k + 1)
                    row, nth = np.nonzero((before < enough) & (sizes[order] > 0))
                    first = before[row, nth] == 0
                    yield pd.DataFrame({"list": order[row, nth], "first": first, "query_id": pdf.vec_id.to_numpy()[row], "q": pdf.v.to_numpy()[row]})

        return run

    probed = "list int, first boolean, query_id long, q array<double>"

    def tiles_of(probes: DataFrame) -> DataFrame:
        asked = np.zeros(len(sizes), np.int64)
        for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect():
            asked[r["list"]] = r["n"]
        return spark.createDataFrame([(i, int(-(-n // TILE)), int(-(-m // TILE))) for i, (n, m) in enumerate(zip(sizes.tolist(), asked.tolist(), strict=True)) if n and m] or [(-1, 1, 1)], "list int, vs int, qs int")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = shared.value
            raw, ask = _unit(_stack(left.v)), _unit(_stack(right.q))
            x, q, ids, who = raw @ index.rotation, ask @ index.rotation, left.vec_id.to_numpy(), right.query_id.to_numpy()
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                a, b = _scan(q[part], x, right.limit.to_numpy()[part], block, doubt)
                own = who[part][a] != ids[b]
                a, b = a[own], b[own]
                score = np.einsum("ij,ij->i", ask[part][a], raw[b])
                order = np.lexsort((ids[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (ids[b][1:] != ids[b][:-1])  # a repeated row stands beside its twin
                a, b, score = a[new], b[new], score[new]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                out.append(pd.DataFrame({"query_id": who[part][a], "vec_id": ids[b], "score": score})[nth < k])
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def run(ask: DataFrame, tiles: DataFrame) -> DataFrame:
        keys = ["list", "vs", "qs"]
        left = _tiles(listed, tiles, "vec_id", "vs", "qs")
        right = _tiles(ask, tiles, "query_id", "qs", "vs")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k)

    asks = good.where("asks").select("vec_id", "v")
    probes = asks.mapInPandas(probe(False), probed)
    tiles = tiles_of(probes)
    near = cut(run(probes.where("first").withColumn("limit", F.lit(4.0)), tiles))
    limits = best(near).groupBy("query_id").agg((2 - 2 * F.min(F.when(F.col("rank") == k, F.col("score"))) + 1e-9).alias("limit"))
    rest = probes.where(~F.col("first")).join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(4.0)))
    found = cut(best(near.unionByName(run(rest, tiles))))
    # ids that repeat with many vectors can leave a query short
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(asks.join(full, "vec_id", "left_anti"))
    if total > k and not short.isEmpty():
        wide = short.mapInPandas(probe(True), probed)
        found = best(found.drop("rank").unionByName(run(wide.withColumn("limit", F.lit(4.0)), tiles_of(wide))))
    return found.select("query_id", "rank", "vec_id", "score")


def _tiles(df: DataFrame, tiles: DataFrame, id_name: str, own: str, other: str) -> DataFrame:
    """Each row in one part of its own side, and copied for each part of the other side."""
    parted = df.join(F.broadcast(tiles.withColumnsRenamed({own: "_own", other: "_other"})), "list")
    parted = parted.withColumn(own, F.pmod(F.xxhash64(id_name), F.col("_own")).cast("int"))
    return parted.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).drop("_own", "_other")
