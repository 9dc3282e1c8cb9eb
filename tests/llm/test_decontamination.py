import random

import numpy as np

from tests.llm.common import docs
from weftgraph.llm import decontamination as dec

BENCH = "item_id long, text string"


def table(seed=1):
    rng = random.Random(seed)
    vocab = ["v%d" % k for k in range(3000)]
    prose = lambda n: [rng.choice(vocab[:40]) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = [prose(30) for _ in range(20)] + [prose(400)]
    texts, truth = [], []
    for k in range(300):
        w, item = prose(rng.randrange(0, 300)), None
        if k % 3 == 0:
            item = k % 21
            part = list(items[item])
            if k % 2:
                for _ in range(len(part) // 7):
                    part[rng.randrange(len(part))] = "edit"
                del part[rng.randrange(len(part))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        texts.append(" ".join(w))
        truth.append(item)
    return items, texts, truth


def test_exact_and_edited_copies_are_found_and_clean_documents_are_not(spark):
    items, texts, truth = table()
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(None, "a b c d"), (77, None), (78, "v1"), (3, " ".join(items[3]))], BENCH)
    df = docs(spark, texts + [None, "", "v1 v2"], extra=True)
    out = {r.doc_id: r for r in dec.find(df, bench).collect()}
    assert len(out) == len(texts) + 3
    for i, item in enumerate(truth):
        assert out[i].best_item == item and out[i].contaminated == (item is not None), i
        assert out[i].n_words == len(texts[i].split())
        if item is not None and i % 2 == 0:
            assert out[i].best_score == 1
    kept = dec.keep(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in out if not out[i].contaminated}
    assert not any(r.contaminated for r in dec.find(df, bench.limit(0)).collect()) and dec.find(df.limit(0), bench).collect() == []


def test_blocks_give_the_same(spark, monkeypatch):
    items, texts, _ = table(2)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], BENCH)
    df = docs(spark, texts + [texts[0], None], [*range(len(texts)), 0, None])
    rows = lambda: sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, r.contaminated, r.best_item) for r in dec.find(df, bench).collect()], key=str)
    whole = rows()
    monkeypatch.setattr(dec, "BLOCK", 1500)
    assert rows() == whole


def test_alignment_equals_a_plain_table():
    rng = np.random.default_rng(0)
    a = [rng.integers(1, 6, rng.integers(3, 20)).astype(np.uint64) for _ in range(50)]
    b = [rng.integers(1, 6, rng.integers(0, 30)).astype(np.uint64) for _ in range(50)]
    for x, y, s in zip(a, b, dec.align(a, b), strict=True):
        h = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert abs(s - h.max() / (2 * len(x))) < 1e-9


def test_paraphrases_with_a_quarter_of_the_words_changed(spark):
    items, _, _ = table(3)
    rng = random.Random(9)
    texts = []
    for item in items[:20]:
        w = ["new%d" % k if rng.random() < 0.25 else x for k, x in enumerate(item)]
        texts.append(" ".join(["v%d" % rng.randrange(3000) for _ in range(50)] + w))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], BENCH)
    found = {r.doc_id: r.best_item for r in dec.find(docs(spark, texts), bench).collect()}
    assert sum(found[k] == k for k in range(20)) >= 18


def test_equals_full_alignment_of_everything(spark):
    """Against Smith-Waterman over every passage and whole document, without seeds or windows."""
    from weftgraph.llm import words

    items, texts, _ = table(5)
    items, texts = items[:20], texts[:120]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], BENCH)
    got = {r.doc_id: {x.item_id: x.score for x in r["items"]} for r in dec.find(docs(spark, texts), bench).collect()}
    h = lambda t: words.word_hashes([t.encode()])[0]
    own = [h(" ".join(w)) for w in items]
    for i, t in enumerate(texts):
        full = dec.align(own, [h(t)] * len(own)) if t else np.zeros(len(own))
        assert all(abs(s - full[k]) < 1e-9 or s < full[k] for k, s in got[i].items())
        assert {k for k in range(len(own)) if full[k] >= 0.5} <= set(got[i]) <= {k for k in range(len(own)) if full[k] >= 0.4}


def test_equal_benchmark_texts_are_the_least_item(spark):
    items, _, _ = table(6)
    t = " ".join(items[0])
    bench = spark.createDataFrame([(9, t), (4, t), (7, t), (4, t)], BENCH)
    out = dec.find(docs(spark, [t, "x y z"]), bench).collect()
    assert [(r.best_item, len(r["items"])) for r in sorted(out, key=lambda r: r.doc_id)] == [(4, 1), (None, 0)]


def test_keep_by_blocks_gives_the_same(spark, monkeypatch):
    items, texts, _ = table(2)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], BENCH)
    df = docs(spark, texts, extra=True)
    whole = {r.doc_id for r in dec.keep(df, bench).collect()}
    monkeypatch.setattr(dec, "BLOCK", 1500)
    assert {r.doc_id for r in dec.keep(df, bench).collect()} == whole


def test_common_words_lose_no_copies(spark, monkeypatch):
    """A vocabulary of 300 words and a quarter of the words changed: against full alignment at least 0.95 is found."""
    from weftgraph.llm import words

    rng = random.Random(12)
    vocab = ["c%d" % k for k in range(300)]
    items = [[rng.choice(vocab) for _ in range(60)] for _ in range(120)]
    texts = []
    for item in items:
        w = [rng.choice(vocab) if rng.random() < 0.25 else x for x in item]
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randrange(200))] + w + [rng.choice(vocab) for _ in range(rng.randrange(200))]))
    texts += [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(100)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], BENCH)
    got = {r.doc_id: {x.item_id for x in r["items"]} for r in dec.find(docs(spark, texts), bench).collect()}
    h = lambda t: words.word_hashes([t.encode()])[0]
    own = [h(" ".join(w)) for w in items]
    full = [dec.align([own[i]], [h(texts[i])])[0] >= 0.4 for i in range(120)]
    assert sum(full) >= 110 and sum(i in got[i] for i in range(120) if full[i]) >= 0.95 * sum(full)
    assert sum(bool(got[i]) for i in range(120, 220)) == 0
    monkeypatch.setattr(dec, "HITS", 50)
    assert {r.doc_id: {x.item_id for x in r["items"]} for r in dec.find(docs(spark, texts[:40]), bench).collect()} == {i: got[i] for i in range(40)}


def test_seeds_kept():
    import numpy as np

    rare = np.full(58, np.log(1e-9))
    assert len(dec.seeds_of(rare)) == 58
    common = np.log(np.linspace(1e-6, 2e-6, 58))
    kept = sorted(dec.seeds_of(common).tolist())
    assert 9 <= len(kept) < 58 and sum(b - a >= 3 for a, b in zip([-3, *kept], kept)) >= 1
    assert len(dec.seeds_of(np.log(np.full(5, 1e-3)))) == 5
