"""Exact substring deduplication by winnowed anchors."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import packs, words

U = np.uint64
#: Order of a document without an id: after all others, and not before another such.
LAST = np.iinfo(np.int64).max


def _order(ids: list) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _groups(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, first places of equal keys in it, and each row's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def _split(x: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(x, np.cumsum([len(k) for k in like])[:-1])


def _anchors(h: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window starts, and each window's anchor: the least hash of its runs of half its length."""
    k = (window + 1) // 2
    places = np.flatnonzero(words.inside(n, window))
    if not len(places):
        return places, np.empty(0, U)
    g = words.runs(h, k, 11)
    m = len(h) - window + 1
    least = g[:m].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : m + j], out=least)
    return places, least[places]


def _windows(h: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes of the windows that start at some places, as 64 and 32 bits."""
    if not len(places):
        return np.empty(0, U), np.empty(0, np.uint32)
    return words.runs(h, window, 12)[places], (words.runs(h, window, 13)[places] >> U(32)).astype(np.uint32)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (and kept_text) of every row.

    A word goes if a window of so many words covers it whose word sequence also
    starts in a document with a smaller id. repeats are the maximal runs of such
    words, as word offsets, end exclusive.

    Seed: each window has an anchor, the least hash of its runs of half its
    length, so that equal windows have equal anchors; hash ranges tell which
    anchors stand in two documents. Extend: only around such anchors are the
    windows, up to half a window to the left and right, held against all other
    documents' by 96-bit hashes and the least id that each starts in. Windows
    that pass are joined to maximal repeats. What a chunk asks is distinct and
    holds the least id only, so a passage in a third of all documents costs an
    entry a chunk.

    Null texts have no words. A document without an id counts as later than all
    others and not as earlier than any. Rows that share an id aren't earlier
    than each other; each gives a row of its own. Further columns are ignored;
    an empty table gives no rows.
    """
    buckets = packs.buckets_of(docs)

    def keep(chunk: int, have: list[list]) -> Iterator[tuple]:
        yield chunk, 0, packs.STATE, pickle.dumps(have[0]), *packs.pack_bytes([t or b"" for t in have[1]], 6)

    def ask(chunk: int, have: list[list]) -> Iterator[tuple]:
        ids, texts = have[0], [t or b"" for t in have[1]]
        h, n = words.word_hashes(texts)
        places, anchor = _anchors(h, n, window)
        who = _order(ids)[words.owners(n)[places]]
        once = np.ones(len(anchor), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])
        anchor, who = anchor[once], who[once]
        order, first, _ = _groups((anchor,))
        keys = anchor[order][first]
        least = np.minimum.reduceat(who[order], first) if len(first) else who
        most = np.maximum.reduceat(who[order], first) if len(first) else who
        yield from packs.asks(chunk, keys, buckets, lambda p: (packs.squeeze(least[p]), np.packbits(least[p] < most[p]).tobytes()))

    def shared(keys: list[np.ndarray], least: list[bytes], several: list[bytes]) -> list[bytes]:
        _, first, of = _groups((np.concatenate(keys),))
        ids = np.concatenate([packs.expand(x, np.int64) for x in least])
        lo, hi, found = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min), np.zeros(len(first), bool)
        np.minimum.at(lo, of, ids)
        np.maximum.at(hi, of, ids)
        found[of[np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(several, keys, strict=True)]) > 0]] = True
        return [np.packbits(x).tobytes() for x in _split((found | (lo < hi))[of], keys)]

    def extend(key: tuple, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state, answers = packs.gather(pdf)
        chunk, ids, texts = int(state.chunk), pickle.loads(state.a), packs.unpack_bytes(state.b, state.c)
        h, n = words.word_hashes(texts)
        places, anchor = _anchors(h, n, window)
        keys = np.unique(anchor)
        cut = np.bincount(packs.bucket_of(keys, buckets), minlength=buckets)
        flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(answers, cut[cut > 0].tolist(), strict=True)]) if answers else np.zeros(0, np.uint8)
        if len(flags) != len(keys):
            raise RuntimeError(packs.UNEQUAL)
        places = places[flags[np.searchsorted(keys, anchor)] > 0] if len(keys) else places
        one, two = _windows(h, places, window)
        who = _order(ids)[words.owners(n)[places]]
        order, first, _ = _groups((one, two))
        least = np.minimum.reduceat(who[order], first) if len(first) else who
        one, two = one[order][first], two[order][first]
        kept = {"ids": ids, "places": packs.squeeze_sorted(places.astype(U))}
        rows = [(chunk, packs.home(chunk, buckets), packs.STATE, pickle.dumps(kept), state.b, state.c)]
        rows += packs.asks(chunk, one, buckets, lambda p: (packs.squeeze(two[p]), packs.squeeze(least[p])))
        yield packs.frame(rows)

    def earliest(keys: list[np.ndarray], two: list[bytes], least: list[bytes]) -> list[bytes]:
        order, first, of = _groups((np.concatenate(keys), np.concatenate([packs.expand(x, np.uint32) for x in two])))
        ids = np.concatenate([packs.expand(x, np.int64) for x in least])
        return [packs.squeeze(x) for x in _split(np.minimum.reduceat(ids[order], first)[of], keys)]

    def remove(_, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state, answers = packs.gather(pdf)
        s, texts = pickle.loads(state.a), packs.unpack_bytes(state.b, state.c)
        h, n = words.word_hashes(texts)
        places = packs.expand_sorted(s["places"]).astype(np.int64)
        least = np.concatenate([packs.expand(x, np.int64) for x in answers]) if answers else np.empty(0, np.int64)
        who = _order(s["ids"])[words.owners(n)[places]]
        places = places[least[_groups(_windows(h, places, window))[2]] < who] if len(places) else places
        step = np.zeros(int(n.sum()) + window + 1, np.int32)
        step[places] += 1
        step[places + window] -= 1
        gone = np.cumsum(step)[: int(n.sum())] > 0
        out, at = [], 0
        for i, t, m in zip(s["ids"], texts, n.tolist(), strict=True):
            off = gone[at : at + m]
            at += m
            edges = np.flatnonzero(np.diff(off, prepend=False, append=False)).tolist()
            all_words = t.split()
            ends = [0, *edges, m]
            kept = b" ".join([w for a, b in zip(ends[0::2], ends[1::2], strict=True) for w in all_words[a:b]])
            out.append((i, m, int(off.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)], kept.decode("utf-8", "replace") if with_text else None))
        done = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"])
        done["doc_id"] = pd.array(done.doc_id, "Int64")
        yield done

    rows = packs.stable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")))
    weigh = lambda have: sum(len(t or b"") for t in have[1]) // 6
    answers = packs.answer(packs.ask_table(rows, 2, weigh, ask), shared)
    candidates = packs.grouped(packs.ask_table(rows, 2, weigh, keep).unionByName(answers), ["chunk"], extend, packs.SCHEMA)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>, kept_text string"
    out = packs.grouped(packs.answer(candidates, earliest), ["chunk"], remove, schema)
    return out if with_text else out.drop("kept_text")
