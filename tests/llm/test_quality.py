import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import docs, some_texts
from weftgraph.llm import boosting, quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_documents_are_told_apart(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.predict(d, quality.fit(d, labels)).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert len(test) > 50 and auc(test.quality.to_numpy(), test.score.to_numpy()) > 0.95
    assert (test.predicted == (test.score >= 0.7)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_odd_tables(spark):
    texts = some_texts(random.Random(1))
    df = docs(spark, texts, [*range(len(texts) - 2), None, 5], extra=True)
    labels = spark.createDataFrame([(k, k % 2 if k % 7 else None, 0) for k in range(40)] + [(None, 1, 0), (999, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    rows = quality.predict(df, model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in rows)
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.predict(df, none).collect()} == {0.5}
    assert quality.predict(df.limit(0), none).collect() == []


def test_trees_fit_an_interaction_and_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    inner = m.feature.shape[1]
    for row in x[:20]:
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - inner]
        assert abs(m.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def plain_fit(x, y, trees, depth, bins, rate=0.15, smooth=1.0, least=10):
    """Boosting by recursion over every split value, without histograms."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = np.log(share / (1 - share))
    total, predict = np.full(len(y), base), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def grow(at, left, g=g, h=h):
            if not left:
                return rate * g[at].sum() / (h[at].sum() + smooth)
            best = (1e-9, None)
            for f, cs in enumerate(cuts):
                for c in cs:
                    lo = at[x[at, f] <= c]
                    hi = at[x[at, f] > c]
                    if min(len(lo), len(hi)) >= least:
                        score = lambda z: g[z].sum() ** 2 / (h[z].sum() + smooth)
                        gain = score(lo) + score(hi) - score(at)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, c, lo, hi))
            if best[1] is None:
                return grow(at, left - 1)
            f, c, lo, hi = best[1]
            return (f, c, grow(lo, left - 1), grow(hi, left - 1))

        tree = grow(np.arange(len(y)), depth)

        def walk(row, node=tree):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        total = total + np.array([walk(r) for r in x])
        predict.append(walk)
    return lambda row: 1 / (1 + np.exp(-(base + sum(w(row) for w in predict))))


def test_the_fit_equals_a_plain_one():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((300, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * rng.random(300) > 0.8) ^ (x[:, 2] > 0.9)).astype(float)
    m, plain = boosting.fit(x, y, trees=4, depth=3, bins=8), plain_fit(x, y, 4, 3, 8)
    assert np.allclose(m.score(x), [plain(r) for r in x], atol=1e-9)


def test_the_query_equals_a_plain_fit_over_all_labelled_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = d.join(labels, "doc_id").withColumn("h", F.xxhash64("doc_id")).toPandas().sort_values("h")
    rows = rows[[zlib.crc32(str(i).encode()) % 4 != 2 for i in rows.doc_id]]
    x = np.array([quality.statistics((t or "").encode()) for t in rows.text])
    y = rows.quality.to_numpy(float)
    m = boosting.fit(x, y)
    want = {i: m.score(np.array([quality.statistics((t or "").encode())]))[0] for i, t in d.select("doc_id", "text").collect()}
    got = quality.predict(d, quality.fit(d, labels)).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7) for r in got)
