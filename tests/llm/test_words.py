import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import packs, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x85é", max_size=40), max_size=8))
def test_words_are_runs_between_ascii_spaces(texts):
    raw = [t.encode() for t in texts]
    h, n = words.word_hashes(raw)
    assert n.tolist() == [len(t.split()) for t in raw]
    known = {}
    for w, x in zip((w for t in raw for w in t.split()), h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_long_texts_and_words_are_cut_at_spaces(monkeypatch):
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"x", b"yy", b"z" * 5000]) for _ in range(300)), b"", b"q" * 20000, b" " * 9000 + b"r"]
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "PIECE", 700)
    assert all((a == b).all() for a, b in zip(whole, words.word_hashes(texts), strict=True))


def test_runs_stay_inside_texts():
    h, n = words.word_hashes([b"a b c", b"", b"b c a b c", b"x"])
    starts = np.flatnonzero(words.inside(n, 3))
    assert starts.tolist() == [0, 3, 4, 5]
    r = words.runs(h, 3, 1)[starts]
    assert r[0] == r[3] and len(set(r.tolist())) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50), st.integers(1, 500))
def test_packing_round_trips_and_ranges_follow_the_order(keys, numbers, buckets):
    k = np.sort(np.array(keys, np.uint64))
    assert (packs.expand_sorted(packs.squeeze_sorted(k)) == k).all()
    x = np.array(numbers, np.int64)
    assert (packs.expand(packs.squeeze(x), np.int64) == x).all()
    b = packs.bucket_of(k, buckets)
    assert (np.diff(b) >= 0).all() and (b >= 0).all() and (b < buckets).all()
    rows = list(packs.asks(7, k, buckets, lambda p: (bytes([1]), b"")))
    assert sum(len(packs.expand_sorted(r[3])) for r in rows) == len(k) and len({r[1] for r in rows}) == len(rows)


def test_contents_round_trip():
    items = [b"", b"abc", b"\x00" * 1000]
    assert packs.unpack_bytes(*packs.pack_bytes(items)) == items and packs.unpack_bytes(*packs.pack_bytes([])) == []


def test_inputs_that_are_no_scans_and_unequal_reads(spark):
    import random

    import pandas as pd
    import pytest

    from tests.llm.common import docs, some_texts
    from weftgraph.llm.stupid_backoff import score
    from weftgraph.llm.substrings import remove_repeats

    df = docs(spark, some_texts(random.Random(3)))
    mixed = df.repartition(5, "text").join(spark.range(1000).withColumnRenamed("id", "doc_id"), "doc_id")
    for f in (remove_repeats, lambda d: score(d).drop("log_score", "mean_log_score")):
        rows = lambda d: sorted(map(str, f(d).collect()))  # noqa: B023, E731
        assert rows(mixed) == rows(df)
    with pytest.raises(RuntimeError):
        packs.gather(pd.DataFrame({"kind": [packs.ASK], "bucket": [0], "b": [b""]}))


def test_chunk_numbers_tell_contents():
    import pyarrow as pa

    def numbers(texts):
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["p", "id", "t"])
        return [n for n, _ in packs.chunks([batch], 2, lambda h: len(h[0]), 10**9)]

    assert numbers([b"a", None]) == numbers([b"a", None]) and len({*numbers([b"a", None]), *numbers([b"a", b""]), *numbers([b"", b"a"])}) == 3
