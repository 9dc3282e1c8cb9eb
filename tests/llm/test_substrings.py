import hashlib
import random

import pytest

from tests.llm.common import docs, some_texts, words
from weftgraph.llm.substrings import remove_repeats


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            m = first.get(tuple(w[k : k + window]))
            if m is not None and (i is None or m < i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [1, 5, 13])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    texts = some_texts(rng)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[9], ids[10], ids[11] = None, None, ids[12], ids[12]  # no id, and an id that repeats
    got = result(remove_repeats(docs(spark, texts, ids, extra=True), window))
    assert got == brute(list(zip(ids, texts, strict=True)), window)


def test_empty_table(spark):
    assert remove_repeats(docs(spark, ["a b"]).limit(0)).collect() == []


def test_hot_passage_and_spans(spark):
    passage = " ".join("p%d" % k for k in range(20))
    texts = ["a%d %s b%d" % (k, passage, k) for k in range(50)]
    out = {r.doc_id: r for r in remove_repeats(docs(spark, texts), with_text=True).collect()}
    assert out[0].n_removed == 0 and all(out[k].kept_text == f"a{k} b{k}" for k in range(1, 50))
    assert [tuple(x) for x in out[7].repeats] == [(1, 21)]


def test_many_chunks_give_the_same(spark, monkeypatch):
    from weftgraph.llm import packs

    monkeypatch.setattr(packs, "CHUNK", 300)
    texts = some_texts(random.Random(8), n=120)
    assert result(remove_repeats(docs(spark, texts), 13)) == brute(list(enumerate(texts)), 13)
