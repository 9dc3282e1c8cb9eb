"""Token counts from piece counts of distinct pre-tokens."""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import packs, words


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file's contents, which travel to the executors; sentencepiece: of that library's kind."""

    contents: bytes
    sentencepiece: bool


@lru_cache(2)
def _counter(vocabulary: Vocabulary):
    """How many pieces each of some strings has, by the library of the vocabulary's kind."""
    if vocabulary.sentencepiece:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.contents)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(vocabulary.contents)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A pre-token is a run of bytes between ASCII spaces. It holds for vocabularies
    whose splitter never joins text across such spaces and drops them, as
    word_bpe_49k.json does; special strings hold no space, so they stay whole.
    Each distinct pre-token is counted once in the whole table, where its hash
    range is answered; chunks join the counts to their documents' pre-token
    frequencies and sum. No ids are made for texts. tokenizer is a path on the
    driver; executors get the file's contents.

    Null texts count as empty: no bytes, no tokens. Null ids and repeated rows
    give a row each; further columns are ignored; an empty table gives no rows.
    """
    buckets = packs.buckets_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(Path(tokenizer).read_bytes(), tokenizer.endswith(".model")))

    def ask(chunk: int, have: list[list]) -> Iterator[tuple]:
        ids, texts = have[0], [t or b"" for t in have[1]]
        h, n = words.word_hashes(texts)
        units = [u for t in texts for u in t.split()]
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        pairs = np.sort(words.owners(n).astype(np.uint64) * np.uint64(max(1, len(keys))) + at.astype(np.uint64))
        new = np.flatnonzero(np.diff(pairs, prepend=np.uint64(2**64 - 1)))
        often = np.diff(np.append(new, len(pairs))).astype(np.uint32)
        state = {"ids": ids, "bytes": [len(t) for t in texts], "pairs": packs.squeeze_sorted(pairs[new]), "often": packs.squeeze(often), "keys": len(keys)}
        yield chunk, packs.home(chunk, buckets), packs.STATE, pickle.dumps(state), b"", b""
        distinct = [units[i] for i in first.tolist()]
        yield from packs.asks(chunk, keys, buckets, lambda p: packs.pack_bytes(distinct[p]))

    def count(_, contents: list[bytes], lengths: list[bytes]) -> list[bytes]:
        asked = [packs.unpack_bytes(a, b) for a, b in zip(contents, lengths, strict=True)]
        distinct = list(dict.fromkeys(u for x in asked for u in x))
        pieces = dict(zip(distinct, _counter(shared.value)([u.decode("utf-8", "replace") for u in distinct]), strict=True))
        return [packs.squeeze(np.array([pieces[u] for u in x], np.uint32)) for x in asked]

    def finish(_, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state, answers = packs.gather(pdf)
        s = pickle.loads(state.a)
        pieces = np.concatenate([packs.expand(x, np.uint32) for x in answers]) if answers else np.empty(0, np.uint32)
        doc, unit = np.divmod(packs.expand_sorted(s["pairs"]), np.uint64(max(1, s["keys"])))
        total = np.bincount(doc.astype(np.int64), packs.expand(s["often"], np.uint32) * pieces[unit.astype(np.int64)].astype(float), len(s["ids"])).astype(np.int64)
        yield pd.DataFrame({"doc_id": pd.array(s["ids"], "Int64"), "n_bytes": np.array(s["bytes"], np.int64), "n_tokens": total, "over_limit": total > limit})

    asked = packs.ask_table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")), 2, lambda rows: sum(len(t or b"") for t in rows[1]) // 6, ask)
    return packs.grouped(packs.answer(asked, count), ["chunk"], finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
