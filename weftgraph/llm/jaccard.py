"""Similarity join of documents by the Jaccard index of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import packs, words
from weftgraph.operators.components import components
from weftgraph.operators.checkpoints import cut

U = np.uint64
#: Bands and their rows: two texts at 0.8 miss all bands with a probability of 2.5e-7.
BANDS, ROWS = 50, 6
#: MinHash values that are compared at a time.
STEP = 20
#: Texts of a group that meet others at once; larger groups meet tile by tile.
TILE = 384
#: Bands shared with a bucket's least entry from which on two entries are close; divides the work, changes no result.
CLOSE = 4
#: Pairs that are compared at once in a task.
PAIRS = 1 << 18
#: Parts of a class where its least id is joined to its entries.
SALTS = 32


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; of the whole text if it has fewer words, none if it has no word."""
    h, _ = words.word_hashes([text])
    return np.unique(words.runs(h, min(size, len(h)), 50 + min(size, len(h)))) if len(h) else h


def minhashes(s: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values, of 32 bits."""
    n = BANDS * ROWS
    mul, add = (stream.astype(np.uint32)[:, None] for stream in (words.stream(n, 61) | U(1), words.stream(n, 62)))
    x, out = (s ^ (s >> U(32))).astype(np.uint32), np.full(n, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        h = x[None, at : at + 512] * mul + add
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        np.minimum(out, h.min(1), out=out)
    return out


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The lower 16 bits of each MinHash value: what is compared, and what bands are made of."""
    return minhashes(s).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row's bands; bands are equal where their values are."""
    values = sketches.reshape(len(sketches), BANDS, ROWS).astype(U)
    key = np.zeros((len(values), BANDS), U) + words.stream(BANDS, 63)
    for r in range(ROWS):
        key = words.mix(key * U(0x9E3779B97F4A7C15) + values[:, :, r])
    return key


def least_matches(threshold: float, doubt: float) -> np.ndarray:
    """For 0, STEP, 2 STEP... values compared: the least matches at which the index may still reach the threshold.

    With a uniform prior the posterior after x matches of n is Beta(x + 1, n - x + 1),
    and P(index >= t) = P(Bin(n + 1, t) <= x). Pairs below doubt are dropped.
    """
    out = []
    for n in range(0, BANDS * ROWS + 1, STEP):
        tail, x = 0.0, -1
        while tail < doubt and x <= n:
            x += 1
            tail += comb(n + 1, x) * threshold**x * (1 - threshold) ** (n + 1 - x)
        out.append(x)
    return np.array(out)


def _verified(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (left[a], right[b]) reach the threshold, exactly. a is sorted."""
    out = np.zeros(len(a), bool)
    cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = left[a[lo]]
        for at in range(lo, hi, 256):
            part = b[at : min(hi, at + 256)]
            lengths = np.array([len(right[j]) for j in part])
            every = np.concatenate([right[j] for j in part])
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            same = np.add.reduceat((own[place] == every).astype(np.int64), np.append(0, np.cumsum(lengths)[:-1]))
            out[at : at + len(part)] = same >= threshold * (len(own) + lengths - same) - 1e-9
    return out


def _ranges(pdf: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order, and for each the places of the rows that it meets, from and to.

    Rows of a group with i = j meet each other once; else those of part i meet those of part j.
    """
    pdf = pdf.drop_duplicates([*keys, "rid"])
    group = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    left = (pdf["at"] == pdf["i"]).to_numpy()
    order = np.lexsort((pdf.rid.to_numpy(), ~left, group))
    pdf, group, left = pdf.iloc[order].reset_index(drop=True), group[order], left[order]
    end = np.searchsorted(group, group, side="right")
    middle = np.searchsorted(group, group) + np.bincount(group, left)[group].astype(np.int64)
    begin = np.where((pdf.i == pdf.j).to_numpy(), np.arange(1, len(pdf) + 1), np.where(left, middle, end))
    return pdf, begin, end


def met(pdf: pd.DataFrame, keys: list[str], least: np.ndarray, threshold: float) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Whole groups, and the places in them of pairs that may reach the threshold.

    Rows hold rid, i, j, at, band, comp, sketch and size (number of n-grams). Where
    band is not negative, pairs of one comp and pairs that share an earlier band are left out.
    """
    pdf, begin, end = _ranges(pdf, keys)
    s, m = np.stack([np.frombuffer(x, np.uint16) for x in pdf.sketch]), pdf["size"].to_numpy()
    band, comp = pdf.band.to_numpy(), pdf.comp.to_numpy()
    upto = np.concatenate([[0], np.cumsum(end - begin)])
    at, kept = 0, []
    while at < len(pdf):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        count = (end - begin)[at:to]
        a = np.repeat(np.arange(at, to), count)
        b = np.arange(len(a)) - np.repeat(upto[at:to] - upto[at], count) + np.repeat(begin[at:to], count)
        at = to
        # an index of t needs sizes within a factor of t
        stay = (m[a] >= threshold * m[b] - 1e-9) & (m[b] >= threshold * m[a] - 1e-9) & ((band[a] < 0) | (comp[a] != comp[b]))
        a, b = a[stay], b[stay]
        matches = np.zeros(len(a), np.int64)
        for k in range(0, BANDS * ROWS, STEP):
            for p in range(0, len(a), 1 << 16):
                part = slice(p, p + (1 << 16))
                matches[part] += (s[a[part], k : k + STEP] == s[b[part], k : k + STEP]).sum(1)
            stay = matches >= least[k // STEP + 1]
            a, b, matches = a[stay], b[stay], matches[stay]
        later = np.flatnonzero(band[a] > 0)
        again = np.zeros(len(a), bool)
        for p in range(0, len(later), 1 << 14):
            k = later[p : p + (1 << 14)]
            same = (s[a[k]] == s[b[k]]).reshape(len(k), BANDS, ROWS).all(2)
            again[k] = same.argmax(1) < band[a[k]]
        kept.append((a[~again], b[~again]))
    yield pdf, np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """For each id that a pair names, the least id of its component: as many links as there are ids, at most."""
    up = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return [(x, top(x)) for x in list(up)]


#: What a tile is told apart by.
TILED = ["key", "band", "i", "j"]


def _sides(own: str, other: str) -> list:
    """A tile's two parts in order, and the part that the row is in, as strings."""
    a, b = F.col(own).cast("string"), F.col(other).cast("string")
    return [F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), a.alias("at")]


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, doubt: float = 1e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f1, f2, copy_id, class_id, n_links, rid, root of every row.

    copy_id is the least id among equal texts, class_id that among all texts that
    links connect, n_links the number of other rows whose n-grams reach the
    threshold (copies included).

    Equal texts are one entry from the start, with their number. Entries with a
    band of MinHash values in common are candidates. Entries that share CLOSE bands
    or more with a bucket's least entry are linked to the least such one, and the
    components of these links are close groups, which meet themselves. Candidates
    of different groups meet inside the bucket of the first band that they share,
    and nowhere else, so a chain of weak links brings no work beyond its buckets.

    Both meetings are dealt in tiles of bounded size, so that groups of any size are
    split over tasks. Values are compared step by step, and a pair goes as soon as
    the posterior probability of reaching the threshold falls below doubt; those
    left are verified on all their n-grams. Buckets compare sketches first and
    get the n-grams of the entries that are left only. No pairs leave a tile, only each
    entry's number of links and a spanning forest.

    Texts with fewer words than an n-gram are one n-gram of all their words. Null
    texts and texts without words are in no class but their own: null ones have no
    copies, empty ones only equal ones. Null ids are never the least; if all are null,
    so is the class id. Repeated rows are copies. Further columns are ignored; an
    empty table gives no rows.
    """
    least = least_matches(threshold, doubt)
    text = F.col(text_col)
    prints = [F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(9), text).alias("f2")]
    all_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *prints, text.isNull().alias("none"))
    own = all_rows.where("NOT none").groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("doc_id").alias("copy_id"))
    entries = cut(own.withColumn("rid", F.monotonically_increasing_id()))

    def bands(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf[at : at + 1024]
                names = list(zip(part.f1.tolist(), part.f2.tolist(), strict=True))
                new = [k for k, x in enumerate(names) if not (x in seen or seen.add(x))]
                grams = [(k, shingles(part.t.iat[k] or b"", size)) for k in new]
                some = [(k, g) for k, g in grams if len(g)]
                if some:
                    keys = band_keys(np.stack([sketch_of(g) for _, g in some])).view(np.int64)
                    at_k = [k for k, _ in some]
                    yield pd.DataFrame({"f1": part.f1.to_numpy()[at_k], "f2": part.f2.to_numpy()[at_k], "keys": list(keys)})

    texts = docs.select(*prints, F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("t")).where(text.isNotNull())
    made = texts.select("f1", "f2", "t").mapInPandas(bands, "f1 long, f2 long, keys array<long>").dropDuplicates(["f1", "f2"])
    keyed = cut(entries.select("f1", "f2", "rid").join(made, ["f1", "f2"]).select("rid", "keys"))

    # each entry's links to the least entries of its buckets, and in how many bands
    banded = keyed.select("rid", F.explode("keys").alias("key"))
    firsts = banded.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("key", "lo")
    near = cut(banded.join(firsts, "key").where("rid <> lo").groupBy("rid", "lo").agg(F.count("*").alias("bands")))
    # an entry is linked to the least of its close ones only, and these among each other
    close = near.where(F.col("bands") >= CLOSE).groupBy("rid").agg(F.min("lo").alias("b"), F.collect_set("lo").alias("los"))
    links = close.select(F.col("rid").alias("a"), "b").unionByName(close.select(F.explode("los").alias("a"), "b").where("a <> b").distinct())
    comps = components(links).withColumnsRenamed({"id": "rid", "root": "comp"})
    parts = comps.groupBy("comp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    candidates = near.select("rid").unionByName(near.select(F.col("lo").alias("rid"))).distinct()
    members = candidates.join(comps, "rid", "left").join(parts, "comp", "left")
    members = cut(members.select("rid", F.coalesce("comp", "rid").alias("comp"), F.coalesce("parts", F.lit(0)).alias("parts")))

    def prepare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                part = pdf[at : at + 1024].drop_duplicates("rid")
                grams = [shingles(t, size) for t in part.t]
                yield part.drop(columns="t").assign(size=[len(g) for g in grams], sketch=[sketch_of(g).tobytes() for g in grams], grams=[g.tobytes() for g in grams])

    named = members.join(entries.select("rid", "n", "f1", "f2", F.col("copy_id").alias("doc_id")), "rid")
    with_text = texts.join(named, (texts.f1 == named.f1) & (texts.f2 == named.f2) & texts.doc_id.eqNullSafe(named.doc_id)).select("comp", "parts", "rid", "n", "t")
    ready = cut(with_text.mapInPandas(prepare, "comp long, parts int, rid long, n long, size long, sketch binary, grams binary"))

    def similar(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in packs.whole(it, TILED):
            for pdf, a, b in met(pdf, TILED, least, threshold):
                grams, order = [np.frombuffer(x, U) for x in pdf.grams], np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                ok = _verified(grams, grams, a, b, threshold)
                a, b, ids, weight = a[ok], b[ok], pdf.rid.to_numpy(), pdf.n.to_numpy()
                count = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
                some = np.flatnonzero(count)
                forest = dict(_forest(ids, a, b))
                yield pd.DataFrame({"rid": ids[some], "links": count[some].astype(np.int64), "top": [forest[x] for x in ids[some].tolist()]})

    # close groups meet themselves, in tiles of their parts
    at = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    inner = ready.where("parts > 0").withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole_groups = inner.select(F.col("comp").alias("key"), F.lit(-1).alias("band"), *_sides("at", "other"), "comp", "rid", "n", "size", "sketch", "grams")

    # buckets that hold several close groups: their parts meet each other; groups of one part share the parts of a bucket
    placed = keyed.join(members, "rid").select("rid", "comp", "parts", F.posexplode("keys").alias("band", "key"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(F.col("parts") < 2).alias("small")).where("lo < hi")
    label = F.when(F.col("parts") < 2, F.pmod(F.xxhash64("comp"), F.ceil(F.col("small") / TILE)).cast("string")).otherwise(F.concat_ws(".", F.col("comp").cast("string"), F.pmod(F.xxhash64("rid"), F.col("parts")).cast("string")))
    labelled = placed.join(mixed.select("key", "small"), "key").select("key", "band", "rid", label.alias("at"), F.when(F.col("parts") > 1, F.col("comp")).alias("big"))
    labels = labelled.select("key", F.col("at").alias("other"), F.col("big").alias("their")).distinct()
    crossing = labelled.join(labels, "key").where(F.coalesce(F.col("big") != F.col("their"), F.lit(True))).select("key", "band", *_sides("at", "other"), "rid")
    sketched = crossing.join(ready.select("rid", "comp", "size", "sketch"), "rid")

    def promising(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in packs.whole(it, TILED):
            for pdf, a, b in met(pdf, TILED, least, threshold):
                yield pdf.iloc[np.union1d(a, b)][["key", "band", "i", "j", "at", "rid"]]

    survivors = cut(packs.by_group(sketched, TILED, promising, "key long, band int, i string, j string, at string, rid long"))
    columns = ["key", "band", "i", "j", "at", "comp", "rid", "n", "size", "sketch", "grams"]
    tiled = whole_groups.select(*columns).unionByName(survivors.join(ready.drop("parts"), "rid").select(*columns))
    found = cut(packs.by_group(tiled, TILED, similar, "rid long, links long, top long"))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("rid").alias("a"), F.col("top").alias("b"))).withColumnRenamed("id", "rid")
    whole = cut(entries.join(linked, "rid", "left").join(tree, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    # each class has SALTS parts where its least id comes back to its entries
    least_id = whole.where("links IS NOT NULL").groupBy("root").agg(F.min("copy_id").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = whole.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(least_id, ["root", "salt"], "left")
    whole = cut(whole.select("f1", "f2", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "rid", "root"))
    full = all_rows.where("NOT none").join(whole, ["f1", "f2"]).select("doc_id", "f1", "f2", "copy_id", "class_id", "n_links", "rid", "root")
    nulls = all_rows.where("none").select("doc_id", "f1", "f2", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("root"))
    return full.unionByName(nulls)


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those whose class holds a smaller id.

    Of rows that share the least id of their class, and in classes without ids, one
    stays. Rows with a null text stay. Columns may have any names.
    """
    made = join(docs, threshold, size, id_col=id_col, text_col=text_col).where("rid IS NOT NULL")
    # one text of each class: the smallest entry that has the class's id
    chosen = made.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("rid", "doc_id", "f1", "f2")).alias("e"), F.count("*").alias("times"))
    chosen = cut(chosen.select("e.doc_id", "e.f1", "e.f2", "times"))
    named = docs.where(F.col(text_col).isNotNull()).select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("f1"), F.xxhash64(F.lit(9), text_col).alias("f2"), F.col(id_col).cast("long").alias("id"))
    chosen = chosen.hint("merge")  # it grows with the corpus: never broadcast, whatever size is guessed
    kept = named.join(chosen, (named.f1 == chosen.f1) & (named.f2 == chosen.f2) & named.id.eqNullSafe(chosen.doc_id)).select("row", named.f1, named.f2, "id", "times")
    single = kept.where("times = 1").select("row.*")
    several = kept.where("times > 1").groupBy("f1", "f2", "id").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(several).unionByName(docs.where(F.col(text_col).isNull()))
