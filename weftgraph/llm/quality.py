"""Quality of documents by boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import boosting, words
from weftgraph.llm.rows import through

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 8_000
#: Kinds of bytes: lower case, upper case, digits, sentence marks, other marks, lines, other space, controls, beyond ASCII.
_KINDS = 9
_KIND = np.full(256, 8, np.uint8)
_KIND[:32], _KIND[127] = 7, 7
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 3
_KIND[10], _KIND[[9, 11, 12, 13, 32]] = 5, 6
#: Marks that are counted on their own.
_MARKS = b"!|#$%&*@=<>{}[]/_"


def _spread(x: np.ndarray) -> tuple[float, float, float]:
    return (float(x.mean()), float(x.std()), float(x.max())) if len(x) else (0.0, 0.0, 0.0)


def statistics(text: bytes) -> list[float]:
    """What the classifier sees of a text: shares of kinds of characters, words, lines, and repetition."""
    raw = np.frombuffer(text, np.uint8)
    size, count = max(1, len(raw)), np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, count, _KINDS) / size
    share = count[count > 0] / size
    h, _ = words.word_hashes([text])
    w = text.split()
    n = max(1, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    distinct = len(np.unique(h))
    triples = words.runs(h, 3, 31)
    lines = [x for x in text.split(b"\n") if x.strip()]
    long = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.fromiter((x[0] for x in w), np.uint8, len(w))
    last = np.fromiter((x[-1] for x in w), np.uint8, len(w))
    out = [*kinds.tolist(), *(count[list(_MARKS)] / n).tolist(), float(-(share * np.log2(share)).sum()), np.log1p(len(w)), np.log1p(len(raw)), distinct / n, len(np.unique(triples)) / max(1, len(triples))]
    out += [*_spread(lengths), *_spread(long), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(lines) / n]
    out += [float((_KIND[first] == k).mean()) if len(w) else 0.0 for k in (0, 1, 2, 4)] + [float((_KIND[last] == k).mean()) if len(w) else 0.0 for k in (0, 1, 2, 3, 4)]
    return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id isn't."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> boosting.Trees:
    """Trees fitted on at most sample labelled rows outside the held-out fold, chosen by a hash of the id.

    Labels without id or value are left out, as are ids without a document. If an
    id repeats, each pairing is a row of its own; the bound holds all the same.
    """
    ids = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    there = docs.select(F.col(id_col).alias("id")).distinct()  # an id without a document takes no place in the sample
    ids = ids.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(ids), "id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"id": pdf.id, "y": pdf.y, "x": [statistics(t or b"") for t in pdf.t]})

    got = rows.mapInPandas(run, "id long, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "y", "x").limit(sample).toPandas()
    x = np.array(got.x.tolist(), float) if len(got) else np.zeros((0, 1))
    return boosting.fit(x, got.y.to_numpy(float))


def _scores(texts: list, model: boosting.Trees) -> np.ndarray:
    out = [model.score(np.array([statistics(t or b"") for t in texts[k : k + 512]])) for k in range(0, len(texts), 512)]
    return np.concatenate(out) if out else np.empty(0)


def predict(docs: DataFrame, model: boosting.Trees, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are scored as empty ones. Null ids aren't held out. Repeated rows
    give a row each; further columns are ignored; an empty table gives no rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            score = _scores(pdf.t.tolist(), model)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": pdf.held_out, "score": score, "predicted": (score >= threshold).astype(int)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: boosting.Trees, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject.

    Null texts are judged as empty ones; null ids and repeated rows like all others. Columns may have any names.
    """
    at = docs.columns.index(text_col)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            texts = batch.column(at)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            yield batch.filter(pa.array(_scores(texts.to_pylist(), model) >= threshold))

    return through(docs, run)
