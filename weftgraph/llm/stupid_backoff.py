"""Language-model scores by stupid backoff over the corpus's own counts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import packs, words

U = np.uint64
_TOTAL = np.zeros(1, U)


def _grams(h: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: the places of last words, and keys; a key of 0 stands for the empty n-gram."""
    out = []
    for k in range(1, order + 1):
        starts = np.flatnonzero(words.inside(n, k))
        key = words.runs(h, k, 20 + k)[starts] if len(starts) else np.empty(0, U)
        out.append((starts + k - 1, np.where(key == 0, U(1), key)))
    return out


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score, n_backed_off of every row.

    The score of a word is c(n-gram) / c(its context) for the longest n-gram that
    the other documents hold, times backoff for each order given up; a word that
    no other document holds scores as one of 1 / (words + 1). Counts are of all
    documents but the scored one. At a document's start shorter contexts are no
    backing off.

    The count table is partitioned by n-gram hash; chunks ask for the counts of
    their distinct n-grams and join them to their documents' own. An n-gram of a
    third of all places costs an entry a chunk. N-grams are told apart by 64-bit
    hashes: among 10^13 distinct ones, one in two million shares its hash.

    Null and empty texts have no words, a sum of 0 and a null mean. Null ids and
    repeated rows give a row each (copies count as other documents); further
    columns are ignored; an empty table gives no rows.
    """
    buckets = packs.buckets_of(docs)

    def keep(chunk: int, have: list[list]) -> Iterator[tuple]:
        yield chunk, 0, packs.STATE, pickle.dumps(have[0]), *packs.pack_bytes([t or b"" for t in have[1]], 6)

    def ask(chunk: int, have: list[list]) -> Iterator[tuple]:
        h, n = words.word_hashes([t or b"" for t in have[1]])
        every = np.sort(np.concatenate([_TOTAL.repeat(len(h)), *(k for _, k in _grams(h, n, order))]))
        first = np.flatnonzero(np.diff(every, prepend=U(1)))
        keys, often = every[first], np.diff(np.append(first, len(every)))
        yield from packs.asks(chunk, keys, buckets, lambda p: (packs.squeeze(often[p]), b""))

    def total(keys: list[np.ndarray], often: list[bytes], _) -> list[bytes]:
        every, at = packs.merged(keys)
        count = np.zeros(len(every), np.int64)
        for a, x in zip(at, often, strict=True):
            count[a] += packs.expand(x, np.int64)
        return [packs.squeeze(count[a]) for a in at]

    def finish(_, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state, answers = packs.gather(pdf)
        ids = pickle.loads(state.a)
        h, n = words.word_hashes(packs.unpack_bytes(state.b, state.c))
        doc = words.owners(n)
        grams = _grams(h, n, order)
        keys = np.sort(np.concatenate([_TOTAL.repeat(min(1, len(h))), *(k for _, k in grams)]))
        keys = keys[np.diff(keys, prepend=U(1)) != 0]
        count = np.concatenate([packs.expand(x, np.int64) for x in answers]) if answers else np.empty(0, np.int64)
        if len(count) != len(keys):
            raise RuntimeError(packs.UNEQUAL)

        def others(key: np.ndarray, of: np.ndarray) -> np.ndarray:
            """How often the other documents hold each n-gram."""
            by_key = np.argsort(key, kind="stable")  # of equal keys, those of a document stand together
            k, d = key[by_key], of[by_key]
            new = np.diff(k, prepend=~k[:1]) != 0
            run = np.flatnonzero(new | (np.diff(d, prepend=-1) != 0))
            own = np.diff(np.append(run, len(k)))
            total = count[np.searchsorted(keys, k[run])]
            out = np.empty(len(k), np.int64)
            out[by_key] = np.repeat(total - own, own)
            return out

        log, level = np.zeros(len(h)), np.zeros(len(h), np.int64)
        best = np.zeros(len(h), np.int64)
        below = (count[0] if len(h) else 0) - n[doc]
        log[:] = -np.log(below + 1.0)
        for k, (last, key) in enumerate(grams, 1):
            best[last] = k
            above = others(key, doc[last])
            context = below if k == 1 else below[last - 1]
            hit = above > 0
            log[last[hit]] = np.log(above[hit] / context[hit])
            level[last[hit]] = k
            below = np.zeros(len(h), np.int64)
            below[last] = above
        # the context of an n-gram that others hold is held by them as well, so no division by 0
        lost = best - np.maximum(level, 1)
        log += np.where(lost > 0, lost, 0) * np.log(backoff)
        sums = np.bincount(doc, log, len(n))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums / n
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": n, "log_score": sums, "mean_log_score": mean, "n_backed_off": np.bincount(doc, lost > 0, len(n)).astype(np.int64)})
        yield out

    rows = packs.stable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")))
    weigh = lambda have: sum(len(t or b"") for t in have[1]) // 6
    answers = packs.answer(packs.ask_table(rows, 2, weigh, ask), total)
    out = packs.grouped(packs.ask_table(rows, 2, weigh, keep).unionByName(answers), ["chunk"], finish, "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("mean_log_score")))
