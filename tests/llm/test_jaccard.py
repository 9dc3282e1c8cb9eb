import random

from tests.llm.common import docs, some_texts, words
from weftgraph.llm import jaccard
from weftgraph.operators.components import components


def grams(t, size=5):
    w = words(t)
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    g = [grams(t) for _, t in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            equal = rows[a][1] is not None and rows[a][1] == rows[b][1]
            if equal or g[a] and g[b] and len(g[a] & g[b]) >= threshold * len(g[a] | g[b]):
                n[a] += 1
                n[b] += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)] = min(i, ids.get(top(k), i))
    return sorted(((i, ids.get(top(k)), n[k]) for k, (i, _) in enumerate(rows)), key=str)


def texts_with_copies(seed):
    rng = random.Random(seed)
    out = some_texts(rng)
    base = ["b%d" % rng.randrange(10**6) for _ in range(120)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out + out[20:30] + ["x", "", None]


def test_equals_brute_force(spark):
    texts = texts_with_copies(1)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    ids[-4:] = [None] * 4
    out = jaccard.join(docs(spark, texts, ids, extra=True)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == brute(list(zip(ids, texts, strict=True)))


def test_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 10)
    texts = texts_with_copies(3)
    out = jaccard.join(docs(spark, texts)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == brute(list(enumerate(texts)))


def test_every_division_of_the_work_gives_the_same(spark, monkeypatch):
    texts = texts_with_copies(5)
    want = brute(list(enumerate(texts)))
    for close, tile, pairs in ((10**6, 384, 1 << 18), (10**6, 7, 50), (12, 7, 50), (1, 7, 50)):  # groups of one to groups of all candidates
        monkeypatch.setattr(jaccard, "CLOSE", close)
        monkeypatch.setattr(jaccard, "TILE", tile)
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        out = jaccard.join(docs(spark, texts)).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == want, (close, tile)


def test_links_grow_with_entries_not_with_bands(spark, monkeypatch):
    rng = random.Random(6)
    base = ["b%d" % rng.randrange(10**6) for _ in range(150)]
    texts = []
    for _ in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    given, old = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: given.append(links.count()) or old(links))
    assert len({r.class_id for r in jaccard.join(docs(spark, texts)).collect()}) == 1
    assert given[0] <= 2 * len(texts)


def test_keep_one_with_clashing_columns(spark):
    texts = texts_with_copies(7)
    names = ("_f1", "_f2", "_id", "_c1", "_c2", "_cid", "_rows", "row", "f1", "f2", "id", "doc", "root", "times", "e", "a b", "c.d")
    df = docs(spark, texts).selectExpr("*", *(f"'{n}' AS `{n}`" for n in names))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, c, _ in brute(list(enumerate(texts))) if i == c)
    assert all(r[n] == n for r in rows for n in names)


def test_keep_one(spark):
    texts = texts_with_copies(4)
    df = docs(spark, [*texts, texts[12]], [*range(len(texts)), 12], extra=True)
    kept = sorted(jaccard.keep_one(df).select("doc_id").toPandas().doc_id.tolist())
    assert kept == sorted(i for i, c, _ in brute(list(enumerate(texts))) if i == c)
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.join(df.limit(0)).collect() == [] and jaccard.keep_one(df.limit(0)).collect() == []


def test_bounds_drop_no_similar_pair():
    least = jaccard.least_matches(0.8, 1e-7)
    assert least[0] == 0 and all(x <= 0.8 * jaccard.STEP * k for k, x in enumerate(least)) and least[-1] > 0.6 * jaccard.BANDS * jaccard.ROWS


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(200)} | {k: 1000 for k in range(1000, 1100)}
