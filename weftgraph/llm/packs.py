"""Keyed look-ups for whole chunks of a table, without a row per key.

A chunk is what one task reads at a stretch (about CHUNK words). It asks about
its distinct keys, already aggregated, one packed row for each range of key
hashes; the task that owns a range merges what all chunks say and answers each;
the answers meet the chunk's own state again. A key that a third of all rows
hold costs one entry a chunk, so no task grows with a hot key, and nothing is
collected. Ranges are of equal shares of the hash space.

Chunks are made inside one task and travel whole, so a task that is run again
after an executor is lost replaces its chunks with equal ones: the input is a
scan or a checkpoint (stable() sees to it). A chunk's number comes from its place
and its contents, so chunks that were read differently never meet, and raise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import mix
from weftgraph.operators.checkpoints import cut

#: Words of a chunk on an executor with MEMORY bytes for each Python worker; with more memory as many times more, up to MOST.
CHUNK, MEMORY, MOST = 1_000_000, 600 << 20, 16
STATE, ASK = 0, 1
UNEQUAL = "the input gave other rows when it was read again"
SCHEMA = "chunk long, bucket int, kind int, a binary, b binary, c binary"
COLUMNS = ["chunk", "bucket", "kind", "a", "b", "c"]
U = np.uint64


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, without the upper ones that hold zeros only."""
    if not len(x):
        return b""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize)
    least, most = int(x.min()), int(x.max())
    used = x.itemsize if least < 0 else max(1, (most.bit_length() + 7) // 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :used].T).tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    raw = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    raw[:, : b[0]] = planes.T
    return raw.view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=U(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, U), dtype=U)


def pack_bytes(items: list[bytes], level: int = 1) -> tuple[bytes, bytes]:
    """Contents and lengths."""
    return zstandard.ZstdCompressor(level=level).compress(b"".join(items)), squeeze(np.array([len(x) for x in items], np.int64))


def unpack_bytes(data: bytes, lengths: bytes) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(expand(lengths, np.int64))
    return [raw[e - n : e] for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]


def chunk_words(df: DataFrame) -> int:
    """Words of a chunk, as the executors' memory outside the JVM allows. No result depends on it."""
    conf = df.sparkSession.sparkContext.getConf()

    def size(name: str) -> float:
        m = re.fullmatch(r"(\d+)([kmgt]?)b?", (conf.get(name) or "0").lower())
        return int(m[1]) * 1024 ** " kmgt".index(m[2] or "m") if m else 0

    each = size("spark.executor.pyspark.memory") or size("spark.executor.memoryOverhead") / int(conf.get("spark.executor.cores") or 1)
    return CHUNK * int(min(MOST, max(1, each // MEMORY)))


def stable(df: DataFrame) -> DataFrame:
    """df if it is a scan with filters and expressions, else a checkpoint of it: something that reads equal each time."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df) if re.search(r"Exchange|Join|Aggregate|MapIn|Python|Sample|Limit|Window|Generate|Sort", plan) else df


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def home(chunk: int, buckets: int) -> int:
    """The range that a chunk's own state visits."""
    return int(bucket_of(mix(np.array([chunk], U)), buckets)[0])


def asks(chunk: int, keys: np.ndarray, buckets: int, beside: Callable[[slice], tuple[bytes, bytes]]) -> Iterator[tuple]:
    """A row for each range that holds some of the sorted keys; beside(part) gives what goes with them."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1)).tolist()
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            part = slice(cut[k], cut[k + 1])
            yield (chunk, k, ASK, squeeze_sorted(keys[part]), *beside(part))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def buckets_of(df: DataFrame) -> int:
    """Ranges: several for each shuffle partition, so that they even out."""
    return 4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterator, columns: int, weigh: Callable[[list], int], size: int) -> Iterator[tuple[int, list[list]]]:
    """(chunk number, its columns) from Arrow batches whose first column is the scan's partition, some size of weight each; the last column holds texts."""

    def name() -> int:
        """From the chunk's place and contents; not negative."""
        known = hashlib.blake2b(f"{part} {seq} {[None if t is None else len(t) for t in have[-1]]} {have[:-1]}".encode(), digest_size=8)
        for t in have[-1]:
            known.update(t or b"")
        return int.from_bytes(known.digest(), "big") >> 1

    part, seq, have, weight = 0, 0, [[] for _ in range(columns)], 0
    for batch in batches:
        at, step = 0, min(256, max(1, size // 4096))
        while at < batch.num_rows:
            part = batch.column(0)[0].as_py()
            rows = [batch.column(i + 1).slice(at, step).to_pylist() for i in range(columns)]
            for h, r in zip(have, rows, strict=True):
                h += r
            weight += weigh(rows)
            at += step
            if weight >= size:
                yield name(), have
                seq, have, weight = seq + 1, [[] for _ in range(columns)], 0
    if have[0]:
        yield name(), have


def grouped(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """fn(key, rows) for each group, from a stream of sorted partitions: little cost for a small group."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in it:
            if not len(pdf):
                continue
            k = pdf[keys].to_numpy()
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(k[a])
                if held and key != last:
                    yield from fn(last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
                    held = []
                held.append(pdf.iloc[a:b])
                last = key
        if held:
            yield from fn(last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def whole(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of a stream that is sorted by keys, cut anew so that groups are whole."""
    rest = None
    for pdf in it:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            other = np.flatnonzero((pdf[keys] != pdf[keys].iloc[-1]).any(axis=1).to_numpy())
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield pdf[:cut]
            rest = pdf[cut:]
    if rest is not None and len(rest):
        yield rest


def by_group(df: DataFrame, keys: list[str], fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """fn over partitions that hold whole groups, sorted by keys."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(fn, schema)


def answer(rows: DataFrame, fn: Callable[[list[np.ndarray], list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """Answers all asks: fn(sorted keys of each asking chunk, b, c) gives an answer for each chunk; states pass."""

    def run(_, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        asked = (pdf.kind == ASK).to_numpy()
        if not asked.all():
            yield pdf[~asked]
        if asked.any():
            q = pdf[asked]
            got = fn([expand_sorted(x) for x in q.a], q.b.tolist(), q.c.tolist())
            yield pd.DataFrame({"chunk": q.chunk, "bucket": q.bucket, "kind": q.kind, "a": [b""] * len(q), "b": got, "c": [b""] * len(q)})

    return grouped(rows, ["bucket"], run, SCHEMA)


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All distinct keys, and where each chunk's keys are among them."""
    every = np.unique(np.concatenate(keys))
    return every, [np.searchsorted(every, k) for k in keys]


def ask_table(df: DataFrame, columns: int, weigh: Callable[[list], int], fn: Callable[[int, list[list]], Iterator[tuple]]) -> DataFrame:
    """Rows of SCHEMA that fn(chunk id, columns) gives for each chunk of df; equal chunks each time that df is read."""
    size = chunk_words(df)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
        for chunk, have in chunks(batches, columns, weigh, size):
            rows = list(fn(chunk, have))
            if not rows:  # it holds nothing to ask about
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return df.select(F.spark_partition_id().alias("_partition"), "*").mapInArrow(run, SCHEMA)


def gather(pdf: pd.DataFrame) -> tuple[pd.Series, list[bytes]]:
    """A chunk's state row and its answers in the order of the sorted keys."""
    states = pdf[pdf.kind == STATE]
    if len(states) != 1:
        raise RuntimeError(UNEQUAL)
    state = states.iloc[0]
    return state, pdf[pdf.kind == ASK].sort_values("bucket").b.tolist()
