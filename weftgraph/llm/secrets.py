"""Secrets in whole texts: fixed patterns, and strings that look random."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.rows import through
from weftgraph.operators.checkpoints import cut

#: Fixed patterns; kinds in the order in which they are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
_WORDS = ("passw", "secret", "token", "api")
#: Strings are tested from this length on, those with separators and those of digits or of letters in one case alone from the others on:
#: below, hyphenated words, words and numbers of accounts fill their bands with p-values as spread as those of random strings (of 582
#: lower-case words of 16 to 22 letters in 4,000 documents, a threshold by band would take 24), so no test of one string tells them apart.
SHORTEST, MARKED, PLAIN = 8, 16, 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: Stretches of a run that one encoding can hold, from the widest.
_PARTS = [re.compile(r"[%s]{%d,}" % (c, SHORTEST)) for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest, each with its alphabet in the order of its values.
ENCODINGS = {
    "digits": _DIGITS,
    "lower": _LOWER,
    "UPPER": _UPPER,
    "letters": _UPPER + _LOWER,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_NO_MIX = frozenset(["digits", "lower", "UPPER", "letters"])
_VALUES = {k: np.array([v.find(chr(c)) for c in range(128)]) for k, v in ENCODINGS.items()}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
#: Bins of p-values in each stratum, and the p-values from which on the numbers above tell how many strings are random.
BINS, UPPER = 200, (0.5, 0.75)


def _plain(s: str) -> bool:
    return s.isdigit() or s.isalpha() and (s.islower() or s.isupper())


def encoding_of(s: str) -> str | None:
    """The narrowest encoding whose alphabet holds s; None if none does, for digits or letters of one case alone that are shorter than PLAIN, and with separators for what is shorter than MARKED."""
    if len(s) < PLAIN and _plain(s) or len(s) < MARKED and not s.isalnum():
        return None
    held = set(s)
    return next((k for k, v in _SETS.items() if held <= v), None)


def _tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def battery(s: str, encoding: str) -> float:
    """p-value of s being uniformly random over the encoding's alphabet.

    Three tests, joined by Fisher's method: chi-squared of the letters (by the
    Wilson-Hilferty approximation, with the variance that short strings have),
    runs above and below the alphabet's middle, and serial correlation of
    neighbours. Small for words, names, paths and patterns.
    """
    v = _VALUES[encoding][np.frombuffer(s.encode(), np.uint8)]
    k, n = len(ENCODINGS[encoding]), len(v)
    x = float((np.bincount(v, minlength=k) ** 2).sum()) * k / n - n
    shape = (k - 1) * n / (2 * (n - 1))  # gamma of mean k - 1 and variance 2 (k - 1)(n - 1) / n
    p = [_tail(((x / (k - 1)) ** (1 / 3) - 1 + 1 / (9 * shape)) * 3 * math.sqrt(shape))]
    high = v >= k // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * _tail(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    d = v - v.mean()
    spread = float((d * d).sum())
    p.append(2 * _tail(abs(float((d[1:] * d[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 2.0 ** (1 - n))
    half = -sum(math.log(max(q, 1e-300)) for q in p)
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping by kind, failing matches dropped."""
    low = text.lower()
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in _WORDS) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return sorted(out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)], key=lambda x: (x[0], x[2]))


def stratum_of(encoding: str, length: int, part: bool = False) -> str:
    """Encoding and length band, two bands for each doubling; parts of longer runs have bands of their own."""
    return f"{encoding}/{min(40, int(2 * math.log2(length)))}{'/part' if part else ''}"


def tested(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p) of the strings that the battery is applied to; none that a fixed pattern touches.

    Separators can belong to an encoding or stand between a path's or a prefix's
    parts: a run that holds some is tested whole, if an encoding holds it, and
    each of its long stretches as well, first those that one encoding holds, then
    those without any separator.
    """
    out, ends, starts = [], [], []
    for x, y, _ in sorted(base):  # the stretches that fixed patterns cover, in order and apart
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    for m in _RUN.finditer(text):
        if m.end() - m.start() < PLAIN and _plain(m[0]):
            continue
        spans = {(m.start(), m.end())}
        if not m[0].rstrip("=").isalnum():
            spans |= {p.span() for form in _PARTS for p in form.finditer(text, m.start(), m.end() - (len(m[0]) - len(m[0].rstrip("="))))}
        for a, b in sorted(spans):
            s = text[a:b].rstrip("=")
            k = bisect_right(ends, a)  # the first stretch that ends behind a
            if (e := encoding_of(s)) and not (k < len(ends) and starts[k] < b) and (len(s) == b - a or b == m.end()):
                out.append((a, b, stratum_of(e, len(s), b - a < len(m[0].rstrip("="))), battery(s, e)))
    return out


def chosen(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans of which one holds another, the outer ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


def inspect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, base, tested: what every text holds, before any decision."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for t in pdf.t:
                t = "" if t is None else t
                b = base_spans(t)
                n = [sum(k == j for _, _, k in b) for j in range(3)]
                rows.append((*n, hashlib.sha256(_digest(b).encode()).hexdigest(), [{"start": x, "end": y, "kind": k} for x, y, k in b], [{"start": x, "end": y, "stratum": s, "p": p} for x, y, s, p in tested(t, b)]))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "tested"])
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64").array)
            yield out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,end:int,kind:int>>, tested array<struct<start:int,end:int,stratum:string,p:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, schema)


def thresholds(inspected: DataFrame, rate: float = 0.05) -> dict[str, float]:
    """For each encoding and length band the p-value from which strings count as random.

    In a band the p-values of random strings are uniform and those of others lie
    near 0, so the upper half tells how many are random. Words' p-values thin out
    slowly, so letters or digits alone count as the upper quarter tells if that is
    less. The threshold is the least at which the expected share of others among
    those above it is at most rate, as far as it goes beyond two standard
    deviations of chance. Only a histogram of a bounded number of bands and bins comes to the
    driver; it covers all strings of the table.
    """
    bins = F.least(F.floor(F.col("x.p") * BINS), F.lit(BINS - 1)).cast("int")
    rows = inspected.select(F.explode("tested").alias("x")).groupBy(F.col("x.stratum").alias("s"), bins.alias("b")).agg(F.count("*").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["s"], np.zeros(BINS))[r["b"]] = r["n"]
    found = {s: limit_of(n, rate, UPPER if s.split("/")[0] in _NO_MIX else UPPER[:1]) for s, n in counts.items()}
    return {s: x for s, x in found.items() if x is not None}


def limit_of(counts: np.ndarray, rate: float, upper: tuple[float, ...]) -> float | None:
    """The threshold that a histogram of p-values gives; None if nothing looks random."""
    above = np.asarray(counts, float)[::-1].cumsum()[::-1]
    random = min(above[int(u * BINS)] / (1 - u) for u in upper)
    if not random:
        return None
    p = np.arange(BINS) / BINS
    wrong = np.maximum(0, above - random * (1 - p) - 2 * np.sqrt(random * (1 - p))) / np.maximum(above, 1)
    return float(p[int(np.argmax(wrong <= rate))]) if (wrong <= rate).any() else None


def scan(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    spans adds to the fixed patterns' those strings of SHORTEST characters and more
    (MARKED, with separators; PLAIN, of digits or of letters in one case alone) that pass the randomness battery of their
    encoding, under control of the share of false ones by length band over the whole
    table. A band of which nothing looks random adds nothing. Runs with separators
    are tested whole and by parts; of spans that hold one another the outer one
    counts. Offsets are code points.

    Null texts are empty: no spans, the hash of nothing. Null ids and repeated rows
    give a row each; further columns are ignored; an empty table gives no rows.
    """
    rows = cut(inspect(docs, id_col, text_col))
    limit = thresholds(rows, rate)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            spans = []
            for base, found in zip(pdf.base, pdf.tested, strict=True):
                more = chosen([(x["start"], x["end"]) for x in found if x["p"] >= limit.get(x["stratum"], 2.0)])
                spans.append(_digest([(x["start"], x["end"], x["kind"]) for x in base] + [(a, b, KINDS.index("random")) for a, b in more]))
            pdf = pdf.drop(columns=["base", "tested"]).assign(spans=spans)
            yield pdf.assign(doc_id=pdf.doc_id.astype("Int64"))

    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, limit: dict[str, float], mark: str = "[SECRET]", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with mark in place of each secret, and size_col (if there is one) as the new length of a changed text.

    Null and empty texts stay as they are, as do repeated rows, null ids and all other columns, whatever their names.
    """
    at, sized = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = sorted([(a, b) for a, b, _ in base] + chosen([(a, b) for a, b, s, p in tested(text, base) if p >= limit.get(s, 2.0)]))
        out, done = [], 0
        for a, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in it:
            old = batch.column(at).to_pylist()
            new = [t if t is None else clean(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if sized is not None:
                columns[sized] = pa.array([n if a == b else len(b) for n, a, b in zip(batch.column(sized).to_pylist(), old, new, strict=True)], batch.column(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return through(docs, run)
