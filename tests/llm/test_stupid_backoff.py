import math
import random
from collections import Counter

from tests.llm.common import docs, some_texts, words
from weftgraph.llm.stupid_backoff import score


def brute(texts, order, backoff):
    count = [Counter() for _ in texts]
    for c, t in zip(count, texts, strict=True):
        w = words(t)
        c[()] = len(w)
        for k in range(1, order + 1):
            c.update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    total = sum(count, Counter())
    out = []
    for c, t in zip(count, texts, strict=True):
        w, sums, lost = words(t), 0.0, 0
        for i in range(len(w)):
            best = min(order, i + 1)
            for k in range(best, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if total[g] - c[g] > 0:
                    sums += math.log(backoff ** (best - k) * (total[g] - c[g]) / (total[g[:-1]] - c[g[:-1]]))
                    lost += k < best
                    break
            else:
                sums += math.log(backoff ** (best - 1) / (total[()] - c[()] + 1))
                lost += best > 1
        out.append((len(w), sums, lost))
    return out


def test_equals_brute_force(spark):
    texts = some_texts(random.Random(5))
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in score(docs(spark, texts, extra=True), order).collect()}
        for i, (n, sums, lost) in enumerate(brute(texts, order, 0.4)):
            r = got[i]
            assert r.n_words == n and r.n_backed_off == lost and abs(r.log_score - sums) < 1e-6 * max(1, n)
            assert (r.mean_log_score is None) == (n == 0)


def test_odd_tables(spark):
    assert score(docs(spark, ["a"]).limit(0)).collect() == []
    assert [r.log_score for r in score(docs(spark, ["a b", "a b"], [None, None])).collect()] == [math.log(0.5)] * 2


def test_many_chunks_give_the_same(spark, monkeypatch):
    from weftgraph.llm import packs

    texts = some_texts(random.Random(6))
    rows = lambda: sorted((r.doc_id, r.n_words, round(r.log_score, 6), r.n_backed_off) for r in score(docs(spark, texts)).collect())
    whole = rows()
    monkeypatch.setattr(packs, "CHUNK", 300)
    assert rows() == whole
