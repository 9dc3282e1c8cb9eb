"""Ranked lexical search by block-max WAND over postings in blocks of variable size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm import packs
from weftgraph.operators.checkpoints import cut

#: Bytes of items' texts that tasks hold at once; more items are searched block by block.
BLOCK = 4 << 20
#: Words of a chunk of documents, postings of a shard, bytes of text that are split at once.
CHUNK, SHARD, PIECE = 1_000_000, 4_000_000, 1 << 20
#: Postings of a block, at most, and the price of a block in units of its list's greatest score.
LONGEST, PRICE = 64, 1.0
#: Documents that are scored before the threshold is looked at again.
FIRST = 64
#: Bytes that stand between terms, and the fold of ASCII capitals.
_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_CHUNKS = "documents long, words long, ids binary, none binary, sizes binary, counts binary, terms binary, often binary"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; pieces end between terms."""
    folded, at = text.translate(_TABLE), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if len(folded) - at > PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass(frozen=True)
class Items:
    """A block of items: ids, the numbers of each one's terms, and all terms by number."""

    ids: list[int]
    of: list[np.ndarray]
    numbers: dict[bytes, int]


def items_of(rows: list) -> Items:
    """Items from rows (item, t); an item's terms are those of all its rows, once each."""
    numbers: dict[bytes, int] = {}
    held: dict[int, set[int]] = {}
    for r in rows:
        own = held.setdefault(r["item"], set())
        for piece in terms(bytes(r["t"])):
            own.update(numbers.setdefault(t, len(numbers)) for t in piece)
    return Items(list(held), [np.array(sorted(x), np.int64) for x in held.values()], numbers)


def postings(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk of documents of a task: how many hold terms, how many terms with repeats, and the postings of the numbered terms."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, kinds = known.value.get, pa.schema([("documents", pa.int64()), ("words", pa.int64()), *((c, pa.binary()) for c in ("ids", "none", "sizes", "counts", "terms", "often"))])
        many = max(1, len(known.value))

        def packed(ids: list, sizes: list[int], hits: list[list[int]]) -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            key = np.repeat(np.arange(len(hits)), [len(h) for h in hits]) * many + np.array([x for h in hits for x in h], np.int64)
            key, often = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, many)
            held, counts = np.unique(doc, return_counts=True)
            none = np.array([ids[i] is None for i in held], np.uint8)
            own = np.array([ids[i] or 0 for i in held], np.int64)
            columns = (own, none, n[held], counts, term.astype(np.int32), often.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), *(pa.array([packs.squeeze(c)], pa.binary()) for c in columns)], schema=kinds)

        ids, sizes, hits, words = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                size, own = 0, []
                for piece in terms(t.as_py() or b""):
                    size += len(piece)
                    own += [x for x in map(number, piece) if x is not None]
                ids.append(i)
                sizes.append(size)
                hits.append(own)
                words += size + 1
                if words >= CHUNK:
                    yield packed(ids, sizes, hits)
                    ids, sizes, hits, words = [], [], [], 0
        if ids:
            yield packed(ids, sizes, hits)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, _CHUNKS)


def holders(chunks: DataFrame, many: int) -> np.ndarray:
    """How many documents hold each of the numbered terms; the answer is as long as the block's vocabulary."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(many, np.int64)
        for pdf in it:
            for x in pdf.terms:
                total += np.bincount(packs.expand(x, np.int32), minlength=many)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    got = chunks.select("terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(many, np.int64)
    out[got.term.to_numpy()] = got.n.to_numpy()
    return out


def cuts(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where blocks begin in lists of scores that lie one behind another.

    The bound of a block is its greatest score. By dynamic programming over each list, the sum of (bound -
    score) over all postings, plus a price for each block, is least: with best(j) the least
    sum of the first j postings, best(j + 1) is the least of best(j + 1 - b) + b * greatest of the last b + price, b
    up to LONGEST. All lists take their j-th step together, longest lists first.
    """
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    price = PRICE * np.maximum.reduceat(scores, starts)[order].astype(float)
    width = np.arange(1, LONGEST + 1, dtype=float)
    greatest, best = np.zeros((len(order), LONGEST)), np.full((len(order), LONGEST), np.inf)
    best[:, 0] = 0
    back = np.zeros(len(scores), np.int64)
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, "left"))
        s = scores[begin[:live] + j].astype(float)
        wide = min(j + 1, LONGEST)
        greatest, best = greatest[:live], best[:live]
        greatest[:, 1:wide] = np.maximum(greatest[:, : wide - 1], s[:, None])
        greatest[:, 0] = s
        total = best[:, :wide] + greatest[:, :wide] * width[:wide]
        at = total.argmin(1)
        back[begin[:live] + j] = at + 1
        new = total[np.arange(live), at] + price[:live]
        best[:, 1:] = best[:, :-1].copy()
        best[:, 0] = new
    first = np.zeros(len(scores), bool)
    left = lengths.copy()
    while len(left):
        left = left - back[starts + left - 1]
        first[starts + left] = True
        starts, left = starts[left > 0], left[left > 0]
    return np.flatnonzero(first)


class Shard:
    """Postings of some documents by term, in blocks with bounds."""

    def __init__(self, chunks: list, weights: np.ndarray, documents: int, words: int) -> None:
        column = lambda c, kind: np.concatenate([packs.expand(x[c], kind) for x in chunks])
        self.ids, self.none = column("ids", np.int64), column("none", np.uint8)
        sizes, counts, term, often = column("sizes", np.int64), column("counts", np.int64), column("terms", np.int32), column("often", np.int32).astype(np.int64)
        if len(sizes) and int(sizes.max()) * 90 * documents >= 1 << 63:
            m = np.array([10 + 90 * int(n) * documents // words for n in sizes], np.int64)
        else:
            m = 10 + 90 * sizes * documents // max(1, words)
        # documents are numbered by size: the scores of a term fall with it, so neighbours have bounds that fit
        by = np.argsort(sizes, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        self.ids, self.none, m = self.ids[by], self.none[by], m[by]
        doc = np.repeat(number, counts)
        score = weights[term] * (1_000_000_000 * often // (1000 * often + 8 * m[doc]))
        by = np.lexsort((doc, term))
        self.doc, self.score, term = doc[by], score[by], term[by]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        lengths = np.diff(np.append(starts, len(term)))
        self.begin = cuts(self.score, starts, lengths)
        self.end = np.append(self.begin[1:], len(term)) if len(term) else self.begin
        # documents of a block, and its bound
        self.first, self.last = self.doc[self.begin], self.doc[self.end - 1]
        self.bound = np.maximum.reduceat(self.score, self.begin) if len(term) else self.score
        at = np.searchsorted(self.begin, np.append(starts, len(term)))
        self.blocks = {int(t): (int(a), int(b)) for t, a, b in zip(term[starts], at[:-1], at[1:], strict=True)}

    def search(self, wanted: np.ndarray, found: tuple, top: int) -> tuple:
        """The top documents for the terms wanted, those found before among them; found: scores, whether ids are null, ids, best first.

        Where the blocks of all lists lie above one another, a stretch of documents has
        one bound: the sum of the bounds of its blocks. Stretches are visited
        from the greatest bound on; a stretch whose bound is below the score of the last of
        the top found is skipped with all its blocks, and as bounds only fall that ends the search. Stretches with an
        equal bound are visited, as ties go to the smaller id.
        """
        spans = [self.blocks[t] for t in wanted.tolist() if t in self.blocks]
        if not spans:
            return found
        own = np.concatenate([np.arange(a, b) for a, b in spans])
        bound = self.bound[own]
        at = np.concatenate([self.first[own], self.last[own] + 1])
        points, place = np.unique(at, return_inverse=True)
        over = np.cumsum(np.bincount(place, np.concatenate([bound, -bound]), len(points)))  # exact: far below 2 ** 53
        size = np.diff(points, append=points[-1])
        by = np.argsort(-over, kind="stable")
        by = by[(over[by] > 0) & (size[by] > 0)]
        k, step = 0, FIRST
        while k < len(by):
            least = found[0][-1] if len(found[0]) == top else 1
            # the next stretches of about step documents, as far as their bounds reach
            stop = k + int(np.searchsorted(np.cumsum(size[by[k:]]), step)) + 1
            some = by[k:stop][over[by[k:stop]] >= least]
            if not len(some):
                break
            found = self._scored(own, points, some, found, top)
            if len(some) < len(by[k:stop]):
                break
            k, step = stop, 2 * step
        return found

    def _scored(self, own: np.ndarray, points: np.ndarray, some: np.ndarray, found: tuple, top: int) -> tuple:
        """found with the documents of some stretches, scored exactly from the blocks that reach into them."""
        inside = np.zeros(len(points) + 1, np.int64)
        inside[some] = 1
        upto = np.concatenate([[0], np.cumsum(inside)])
        low, high = np.searchsorted(points, self.first[own]), np.searchsorted(points, self.last[own], "right")
        blocks = own[upto[high] > upto[low]]
        length = self.end[blocks] - self.begin[blocks]
        at = np.repeat(self.begin[blocks] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        doc = self.doc[at]
        held = inside[np.searchsorted(points, doc, "right") - 1] > 0
        docs, place = np.unique(doc[held], return_inverse=True)
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, place, self.score[at[held]])
        docs, score = docs[score > 0], score[score > 0]
        score, none, ids = (np.concatenate(x) for x in zip(found, (score, self.none[docs], self.ids[docs]), strict=True))
        best = np.lexsort((ids, none, -score))[:top]
        return score[best], none[best], ids[best]


def search(docs: DataFrame, benchmark: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the top documents of every item.

    Every text is read whole, once for each block of items, where its postings of the
    items' terms are kept beside the corpus counts; these give the weights. Each task then
    inverts its own documents, shard by shard, cuts the lists into blocks and searches
    every item with the threshold that its earlier shards have reached. Only the top rows of each item leave a task; documents
    are never shuffled.

    Items are a stated set, held in blocks of BLOCK bytes; one item's terms must fit a
    task. Items without an id are left out; rows of one item id are one item; null texts
    have no terms, and an item without terms or matches has no rows. Null doc_ids come after
    all others of their score; repeated rows are ranked each; further columns are ignored;
    empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    count = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK))
    out = None
    for k in range(count):
        block = items_of(items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k).collect())
        part = _search(docs, block, top, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, block: Items, top: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, doc_id, score: the top documents of each task for the items of a block."""
    chunks = cut(postings(docs, block.numbers, id_col, text_col))
    n, words = (int(x or 0) for x in chunks.agg(F.sum("documents"), F.sum("words")).first())
    df = holders(chunks, len(block.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((block.ids, block.of, weights))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, of, weight = shared.value
        empty = (np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64))
        found = [empty] * len(ids)

        def shard(some: list) -> None:
            s = Shard(some, weight, n, words)
            for i, wanted in enumerate(of):
                found[i] = s.search(wanted, found[i], top)

        held, size = [], 0
        for pdf in it:
            for r in pdf.to_dict("records"):
                held.append(r)
                size += len(packs.expand(r["terms"], np.int32))
                if size >= SHARD:
                    shard(held)
                    held, size = [], 0
        if held:
            shard(held)
        score, none, own = (np.concatenate([f[k] for f in found] or [empty[k]]) for k in range(3))
        yield pd.DataFrame({"item_id": np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found]), "doc_id": pd.array(np.where(none > 0, None, own), "Int64"), "score": score})

    return chunks.drop("documents", "words").mapInPandas(run, "item_id long, doc_id long, score long")
