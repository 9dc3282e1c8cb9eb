import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm.common import docs, some_texts
from weftgraph.llm import packs, ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, items, top=10):
    """(item, rank, doc, score) of rows (doc_id, text) by scoring every document."""
    of = [Counter(terms(t)) for _, t in rows]
    n_docs, words = sum(bool(c) for c in of), sum(c.total() for c in of)
    df = Counter(t for c in of for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        scored = []
        for (doc, _), c in zip(rows, of, strict=True):
            m = 10 + 90 * c.total() * n_docs // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, rows, items, parts=3, **more):
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows], extra=True).repartition(parts)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranking.search(d, b, **more).collect()), key=str)


def texts_of(rng, n, vocab=120, long=80):
    word = lambda: f"w{int(rng.paretovariate(0.8)) % vocab}"
    return [rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randrange(long))) for _ in range(n)]


def test_equals_scoring_every_document(spark, monkeypatch):
    rng = random.Random(1)
    texts = [*texts_of(rng, 400), *some_texts(rng, 40), "É é W1 w1_W1", "\x00w1\x7fw2", "w1\U0010ffff"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (None, None)]
    items = [(k, " ".join(t.split()[:20])) for k, t in enumerate(texts_of(rng, 25))] + [(90, ""), (91, None), (92, "nowhere"), (None, "w1"), (93, "w5 W6"), (93, "w7"), (94, texts[3]), (95, texts[3])]
    want = brute(rows, items)
    assert found(spark, rows, items) == want
    monkeypatch.setattr(ranking, "BLOCK", 200)  # several blocks of items
    assert found(spark, rows, items) == want


def test_many_chunks_and_ties(spark):
    """Groups of equal copies over several tasks: the smaller ids win, in whatever shard they are."""
    rng = random.Random(2)
    texts = texts_of(rng, 30)
    rows = [(5000 - k, texts[k % 30]) for k in range(1200)]
    items = [(k, texts[k]) for k in range(30) if texts[k]]
    assert found(spark, rows, items, parts=5) == brute(rows, items)
    assert found(spark, rows, items, parts=5, top=3) == brute(rows, items, 3)


def shard(rng, lists, documents):
    """A shard with postings (term, doc) of given frequencies."""
    sizes, counts, term, often = [], [], [], []
    for d in range(documents):
        own = sorted(t for t in range(lists) if rng.random() < 1 / (1 + t))
        counts.append(len(own))
        term += own
        often += [1 + int(rng.paretovariate(1.2)) for _ in own]
        sizes.append(5 + int(rng.paretovariate(1) * 20) % 2000)
    pack = lambda x, kind: packs.squeeze(np.array(x, kind))
    chunk = {"ids": pack(range(documents), np.int64), "none": pack([0] * documents, np.uint8), "sizes": pack(sizes, np.int64), "counts": pack(counts, np.int64), "terms": pack(term, np.int32), "often": pack(often, np.int32)}
    return ranking.Shard([chunk], np.arange(1, lists + 1) * 100, documents, sum(sizes))


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 40, 3, 200])
    scores = rng.integers(1, 1000, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    got = ranking.cuts(scores, starts, lengths)
    for a, n in zip(starts, lengths, strict=True):
        s = scores[a : a + n]
        price = ranking.PRICE * s.max()
        best, cost = [0.0], lambda cut: sum(s[x:y].max() * (y - x) + price for x, y in zip(cut[:-1], cut[1:], strict=True))
        for j in range(1, n + 1):
            best.append(min(best[j - b] + s[j - b : j].max() * b + price for b in range(1, min(j, ranking.LONGEST) + 1)))
        mine = [*(got[(got >= a) & (got < a + n)] - a).tolist(), int(n)]
        assert mine[0] == 0 and math.isclose(cost(mine), best[n])


def test_blocks_hold_all_and_are_skipped():
    rng = random.Random(4)
    s = shard(rng, 12, 3000)
    assert all(s.bound[k] == s.score[a:b].max() and s.doc[a] == s.first[k] and s.doc[b - 1] == s.last[k] for k, (a, b) in enumerate(zip(s.begin, s.end, strict=True)))
    assert s.begin[0] == 0 and s.end[-1] == len(s.doc) and (s.begin[1:] == s.end[:-1]).all()
    seen, real = [], s._scored
    s._scored = lambda own, points, some, *rest: (seen.append(int(np.diff(points, append=points[-1])[some].sum())), real(own, points, some, *rest))[1]
    empty = (np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64))
    wanted = np.array([0, 5])
    got = s.search(wanted, empty, 10)
    every = np.zeros(3000, np.int64)
    term = np.repeat(sorted(s.blocks), [s.end[b - 1] - s.begin[a] for _, (a, b) in sorted(s.blocks.items())])
    np.add.at(every, s.doc[np.isin(term, wanted)], s.score[np.isin(term, wanted)])
    best = np.lexsort((s.ids, -every))[:10]
    assert got[0].tolist() == every[best].tolist() and got[2].tolist() == s.ids[best].tolist()
    assert sum(seen) < 1800  # of 3,000 documents
    seen.clear()
    s.search(wanted, (np.full(10, 10**15), np.zeros(10, np.uint8), np.arange(10)), 10)
    assert not seen  # a high threshold skips all


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(5)
    text = "-".join("w%d" % rng.randrange(50) for _ in range(3000))
    whole = terms(text)
    monkeypatch.setattr(ranking, "PIECE", 100)
    assert [t.decode() for p in ranking.terms(text.encode()) for t in p] == whole


def test_empty_tables(spark):
    items = [(1, "a b")]
    assert found(spark, [], items, 1) == [] == found(spark, [(1, None), (2, "  ")], items)
    assert found(spark, [(1, "a b")], []) == []
    big = [(1, "a " * 5), (2, "b " * 40000)]
    assert found(spark, big, items) == brute(big, items)
