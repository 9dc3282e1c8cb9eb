"""Benchmark passages in training documents: rare seeds, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import words
from weftgraph.llm.rows import through
from weftgraph.operators.checkpoints import cut

#: Words of a seed, bytes of a benchmark block (which is broadcast), words of a passage that is aligned at once.
SEED, BLOCK, PASSAGE = 3, 8 << 20, 128
#: Seeds up to this expected share of all places are rare and kept; beyond them a passage keeps its rarest until, with EDITED of all words
#: changed, the chance that none of those apart from each other is left is at most MISSED, or all seeds are kept.
RARE, EDITED, MISSED = 1e-8, 0.25, 0.01
#: Hits of seeds that are looked at at once.
HITS = 1 << 21
MATCH, MISS, GAP = 2, 1, 1
U = np.uint64


@dataclass
class Block:
    """Some benchmark passages and the sorted seeds that lead to them."""

    items: list
    passages: list[np.ndarray]
    item_of: np.ndarray
    keys: np.ndarray
    passage_of: np.ndarray
    offset: np.ndarray
    filter: np.ndarray


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(44)).astype(np.int64)


def _frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> tuple[np.ndarray, int]:
    """How often the corpus holds each word of a sorted vocabulary, and all its words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        known = np.zeros(1 << 20, bool)
        known[_slot(vocab)] = True
        count, total = np.zeros(len(vocab), np.int64), 0
        for pdf in it:
            for at in range(0, len(pdf), 512):
                h, _ = words.word_hashes([t or b"" for t in pdf.t[at : at + 512]])
                total += len(h)
                h = h[known[_slot(h)]]
                place = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                count += np.bincount(place[vocab[place] == h], minlength=len(vocab))
        some = np.flatnonzero(count)
        yield pd.DataFrame({"at": np.append(some, -1), "n": np.append(count[some], total)})

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    own = rows[rows["at"] >= 0]
    out[own["at"].to_numpy()] = own.n.to_numpy()
    return out, int(rows.n[rows["at"] < 0].sum())


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """item, t of the benchmark's distinct texts, and in how many blocks of about BLOCK bytes they are read.

    Equal texts are one item, that of the least id. Items without an id or a text are left out.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("t")).where("item IS NOT NULL AND t IS NOT NULL").groupBy("t").agg(F.min("item").alias("item"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return items, max(1, -(-size // BLOCK))


def seeds_of(chance: np.ndarray) -> np.ndarray:
    """The seeds that a passage keeps, from the logarithms of their expected shares: all rare ones, and as many as MISSED asks for."""
    order = np.argsort(chance, kind="stable")
    apart = int(np.ceil(np.log(MISSED) / np.log1p(-((1 - EDITED) ** SEED))))
    taken, n = np.zeros(len(chance) + SEED, bool), 0
    for k, at in enumerate(order.tolist()):
        if n == apart and chance[at] > np.log(RARE):
            return order[:k]
        if not taken[at : at + SEED].any():
            taken[at : at + SEED] = True
            n += 1
    return order


def block_of(docs: DataFrame, items: DataFrame, k: int, count: int, text_col: str = "text") -> Block | None:
    """The k-th of count blocks of the benchmark with its rare seeds; None if it has no seed.

    Rarity is what the words' shares of the corpus let expect, not how often the
    seed itself occurs, so that a passage that leaked into many documents keeps
    its seeds.
    """
    rows = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(count)) == k).orderBy("item", "t").collect()
    passages, item_of = [], []
    for n, r in enumerate(rows):
        h, _ = words.word_hashes([bytes(r["t"])])
        cuts = max(1, -(-len(h) // PASSAGE))
        for p in np.array_split(h, cuts):
            if len(p) >= SEED:
                passages.append(p)
                item_of.append(n)
    if not passages:
        return None
    vocabulary = np.unique(np.concatenate(passages))
    often, total = _frequencies(docs, vocabulary, text_col)
    share = np.log((often + 1) / (total + 1))
    keys, of, offset = [], [], []
    for n, p in enumerate(passages):
        s = share[np.searchsorted(vocabulary, p)]
        chance = sum(s[j : len(p) - SEED + 1 + j] for j in range(SEED))
        use = seeds_of(chance)
        keys.append(words.runs(p, SEED, 41)[use])
        of.append(np.full(len(use), n))
        offset.append(use)
    keys, of, offset = (np.concatenate(x) for x in (keys, of, offset))
    order = np.argsort(keys, kind="stable")
    known = np.zeros(1 << 20, bool)
    known[_slot(keys)] = True
    return Block([r["item"] for r in rows], passages, np.array(item_of), keys[order], of[order], offset[order], known)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, as shares of the first's best possible."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: len(items[i]))
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        m, n = max(len(items[i]) for i in some), max(len(texts[i]) for i in some)
        a, b = np.zeros((len(some), m), U), np.zeros((len(some), n), U)
        real = np.zeros((len(some), m), bool)
        held = np.zeros((len(some), n), bool)
        for r, i in enumerate(some):
            a[r, : len(items[i])], b[r, : len(texts[i])] = items[i], texts[i]
            real[r, : len(items[i])], held[r, : len(texts[i])] = True, True
        row, best, slope = np.zeros((len(some), n + 1), np.int32), np.zeros(len(some), np.int32), GAP * np.arange(n + 1, dtype=np.int32)
        for j in range(m):
            same = (a[:, j : j + 1] == b) & real[:, j : j + 1] & held
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(np.where(same, row[:, :-1] + MATCH, row[:, :-1] - MISS), row[:, 1:] - GAP)
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + slope, 1) - slope  # gaps in the item
            best = np.maximum(best, row.max(1))
        out[some] = best / (MATCH * np.array([len(items[i]) for i in some]))
    return out


def _found(texts: list[bytes], block: Block, threshold: float) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Words of each text, and its items with their best scores from the threshold on."""
    h, n = words.word_hashes(texts)
    found: list[dict] = [{} for _ in texts]
    key = words.runs(h, SEED, 41)
    place = np.flatnonzero(block.filter[_slot(key)] & words.inside(n, SEED)) if len(key) else np.empty(0, np.int64)
    lo, hi = np.searchsorted(block.keys, key[place], "left"), np.searchsorted(block.keys, key[place], "right")
    many = np.cumsum(hi - lo)
    ends, edges = np.cumsum(n), [0]
    while edges[-1] < len(place):  # candidates that two parts share are aligned in both
        edges.append(max(edges[-1] + 1, int(np.searchsorted(many, (many[edges[-1] - 1] if edges[-1] else 0) + HITS, "right"))))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        who, items, parts = _candidates(block, h, n, ends, place[a:b], lo[a:b], hi[a:b])
        for (d, item), s in zip(who, align(items, parts).tolist(), strict=True):
            if s >= threshold:
                found[d][item] = max(s, found[d].get(item, 0.0))
    return n, found


def _candidates(block: Block, h: np.ndarray, n: np.ndarray, ends: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list, list, list]:
    """(text, item), passage and window of words of each candidate that the hits at some places give."""
    hits = np.repeat(np.arange(len(place)), hi - lo)
    seed = np.arange(len(hits)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[hits]
    where, passage = place[hits], block.passage_of[seed]
    begin = where - block.offset[seed]
    doc = words.owners(n)[where]
    order = np.lexsort((begin, passage, doc))
    doc, passage, begin = doc[order], passage[order], begin[order]
    length = np.array([len(p) for p in block.passages])[passage]
    pad = length // 4 + 4
    # hits on near diagonals are one candidate
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1]) | (begin[1:] - begin[:-1] > pad[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    items, parts, who = [], [], []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        d = int(doc[a])
        # a long run of near hits is aligned in windows that overlap by a passage's length
        start, stop, width = int(begin[a] - pad[a]), int(begin[b] + length[a] + pad[a]), int(3 * length[a] + 2 * pad[a])
        step = width - int(length[a] + pad[a])
        for s in range(start, max(start + 1, stop - (width - step)), step):
            items.append(block.passages[passage[a]])
            parts.append(h[max(s, int(ends[d] - n[d])) : min(s + width, stop, int(ends[d]))])
            who.append((d, block.items[block.item_of[passage[a]]]))
    return who, items, parts


def _in_parts(texts: list, block: Block, threshold: float) -> Iterator[tuple[np.ndarray, list[dict]]]:
    for at in range(0, len(texts), 512):
        yield _found([t or b"" for t in texts[at : at + 512]], block, threshold)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, contaminated, best_item, best_score, items (id and score) of every row.

    A document is contaminated if the local alignment of one of its passages with
    a benchmark passage scores at least threshold of the best possible: 1 is a
    whole exact copy; with a fifth of the words changed it is about 0.7, with two
    fifths about 0.4. Only
    places where a run of SEED words is shared that the passage keeps as a seed are aligned: all rare
    ones, and at least so many that a copy with EDITED of its words changed loses them all with a chance of MISSED
    (all, if a passage is too short for that). Items of over
    PASSAGE words are held piece by piece. Ties go to the smaller item id.

    The benchmark is a stated set; it is broadcast in blocks of BLOCK bytes, one
    at a time, and the documents pass each block. Equal benchmark texts are one item, that of the least
    id. Null and empty texts have no words and no items. Null ids and repeated rows
    give a row each; further columns are ignored; an empty benchmark finds nothing;
    an empty table gives no rows.
    """
    keys = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("f1"), F.xxhash64(F.lit(9), text_col).alias("f2")]
    schema = "doc_id long, f1 long, f2 long, n_words long, items array<struct<item_id:long,score:double>>"

    def one(block) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                sizes, items = [], []
                if block is None:
                    sizes, items = [words.word_hashes([t or b""])[1] for t in pdf.t], [[]] * len(pdf)
                else:
                    for n, found in _in_parts(pdf.t.tolist(), block.value, threshold):
                        sizes.append(n)
                        items += [[{"item_id": k, "score": v} for k, v in f.items()] for f in found]
                yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "f1": pdf.f1, "f2": pdf.f2, "n_words": np.concatenate(sizes) if sizes else [], "items": items})

        return docs.select(*keys, F.col(text_col).cast("binary").alias("t")).mapInPandas(run, schema)

    items, count = items_of(benchmark)
    if count == 1:
        block = block_of(docs, items, 0, 1, text_col)
        out = one(block and docs.sparkSession.sparkContext.broadcast(block))
    else:
        hits, names = None, ["doc_id", "f1", "f2"]
        for k in range(count):
            if block := block_of(docs, items, k, count, text_col):
                shared = docs.sparkSession.sparkContext.broadcast(block)
                part = cut(one(shared).where(F.size("items") > 0).select(*names, "items").distinct())
                shared.unpersist()
                hits = part if hits is None else hits.unionByName(part)
        out = one(None)
        if hits is not None:
            hits = hits.groupBy(*names).agg(F.flatten(F.collect_set("items")).alias("found")).withColumnsRenamed({x: f"{x}_" for x in names})
            out = out.join(hits, (F.col("f1") == F.col("f1_")) & (F.col("f2") == F.col("f2_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left").withColumn("items", F.coalesce("found", "items"))
    items = F.array_sort("items", lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"])).otherwise(F.signum(a["item_id"] - b["item_id"])).cast("int"))
    out = out.withColumn("items", items)
    best = F.try_element_at("items", F.lit(1))
    return out.select("doc_id", "n_words", (F.size("items") > 0).alias("contaminated"), best["item_id"].alias("best_item"), best["score"].alias("best_score"), "items")


def keep(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark passage.

    Null and empty texts hold none and stay, as do rows with null ids; repeated rows stay or go alike. Columns may
    have any names. An empty benchmark keeps all.
    """
    at, out = docs.columns.index(text_col), docs

    def passing(shared):
        def run(it: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in it:
                texts = batch.column(at)
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
                clean = [not f for _, found in _in_parts(texts, shared.value, threshold) for f in found]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    items, count = items_of(benchmark)
    for k in range(count):
        if block := block_of(docs, items, k, count, text_col):
            shared = docs.sparkSession.sparkContext.broadcast(block)
            out = through(out, passing(shared))
            if count > 1:
                out = cut(out)
                shared.unpersist()
    return out
