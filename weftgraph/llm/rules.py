"""Quality rules whose cutoffs are chosen under a proven limit on false rejection, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.checkpoints import cut

#: Strata whose cutoffs are broadcast, at most; with more, they are joined by a shuffle in which each stratum has SALTS parts.
FEW, SALTS = 20_000, 64
#: How many cutoffs each rule has, from the mildest to the strictest.
NOTCHES = 12
#: First digits of the digests of the texts that tune, a quarter of all.
TUNING = ("0", "4", "8", "c")
SPACE = "\\x20\\x09-\\x0D"


@dataclass(frozen=True)
class Rule:
    """Rejects where over / under reaches a cutoff; the cutoffs lie on a geometric line between two values, whatever the data."""

    name: str
    over: str
    under: str
    mild: float
    strict: float

    def cutoffs(self) -> list[float]:
        step = (self.strict / self.mild) ** (1 / (NOTCHES - 1))
        return [float(f"{self.mild * step**k:.6g}") for k in range(NOTCHES)]


RULES = (
    Rule("symbols", "n_symbols", "n_words", 4.0, 0.1),
    Rule("marks", "n_marks", "n_words", 4.0, 0.1),
    Rule("capitals", "n_upper", "word_chars", 1.0, 0.25),
    Rule("digits", "n_digits", "word_chars", 0.9, 0.1),
    Rule("repeated words", "n_repeat_words", "n_words", 0.5, 0.1),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.9, 0.1),
    Rule("long words", "word_chars", "n_words", 40.0, 10.0),
    Rule("short words", "n_words", "word_chars", 1.0, 0.4),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _held(text: Column, letters: str) -> Column:
    """How many characters of text are among letters, a class of a regular expression."""
    return F.char_length(F.regexp_replace(text, f"[^{letters}]+", ""))


def _repeated(w: Column) -> Column:
    """How many of the words w stand in a run of three that occurs twice or more.

    Runs are compared whole, never by hashes: sorted with their places, equal ones are
    neighbours. Texts without any repeated run, most of them, are told by a set.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ordered = F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["r"] == F.coalesce(F.get(s, k - 1)["r"], F.lit(""))) | (x["r"] == F.coalesce(F.get(s, k + 1)["r"], F.lit(""))))
        at = F.sort_array(F.transform(same, lambda x: x["i"]))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    held = F.transform(F.array(ordered), covered)  # binds the sorted array to a name: it is made once
    return F.when((F.size(w) < 4) | (F.size(F.array_distinct(runs)) == F.size(w) - 2), F.lit(0)).otherwise(F.get(held, F.lit(0))).cast("long")


def statistics(docs: DataFrame, stratum: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum, digest (of the text), the base statistics, base_failed and what the rules divide, of every row; no row holds text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")) if stratum else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), named.alias("stratum"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = rows.withColumn("lines", lines)
    held = lambda letters: _held(F.col("t"), letters)
    count = {
        "n_words": F.size("w"),
        "word_chars": F.char_length(F.array_join("w", "")),
        "n_symbols": held("#*$%&|<>"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("w")),
        "n_lines": F.size("lines"),
        "n_marks": held("!?"),
        "n_upper": held("A-Z"),
        "n_digits": held("0-9"),
    }
    rows = rows.select("doc_id", "stratum", F.md5("t").alias("digest"), *(v.cast("long").alias(k) for k, v in count.items()))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _notches() -> Column:
    """For each rule the first notch, from 1, at which it rejects; NOTCHES + 1 if none does."""
    def first(r: Rule) -> Column:
        value = F.when(F.col(r.under) > 0, F.col(r.over) / F.col(r.under)).otherwise(0.0)
        return F.lit(NOTCHES + 1) - sum((value >= c).cast("int") for c in r.cutoffs())

    return F.array(*map(first, RULES))


def _ln_factorial(n: Column) -> Column:
    """ln n!: exact products up to 20, Stirling's series beyond (its error is below 1e-12 there)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5.0))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """The chance of k or fewer among n where each has a chance of rate; 1 where k is not below what is expected.

    Terms are added from k downward, each from the one before. Those more than 60 root n
    below k are zero in double precision and left out, so long arrays don't arise.
    """
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    low = F.greatest(F.lit(0).cast("long"), k - F.ceil(60 * F.sqrt(n)) - 100)
    down = F.sequence(k, low, F.lit(-1).cast("long"))
    step = lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * i / (n - i + 1) * ((1 - rate) / rate)).alias("term"))
    total = F.aggregate(down, F.struct(F.lit(0.0).alias("sum"), top.alias("term")), step, lambda a: a["sum"])
    return F.when((n <= 0) | (k >= n * rate), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def fit(stats: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """A row for each stratum with labels: caps (a notch for each rule), notch, n_good, n_rejected, p_value, n_strata.

    Labelled texts that pass the base rules are split by a hash of the text: a quarter
    tunes, the rest is held out. Tuning gives each rule of a stratum its cap: of the
    notches that reject at most rate / number of rules of the good texts, the mildest of
    those that reject most bad ones; 0, if none rejects a bad one. Then all rules are
    tightened together, notch by notch, each up to its cap. A step is allowed if the
    held-out good texts show, by the exact binomial tail, that its share of false
    rejections is below rate: tail <= error / number of strata. The steps of a stratum are
    tested in their fixed order and end at the first that isn't allowed, which needs no further
    correction; strata share the error equally (Bonferroni). So with a chance of
    1 - error no stratum rejects more than rate of its good texts.

    Equal texts count once in a stratum, else copies would pass for evidence. An id
    with several labels is good only if all are; null labels and ids are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = stats.where("NOT base_failed").select("doc_id", "stratum", "digest", _notches().alias("notches")).join(known, "doc_id")
    rows = rows.groupBy("stratum", "digest").agg((F.min("y") == 1).alias("good"), F.min("notches").alias("notches"))
    rows = cut(rows.withColumn("held", ~F.substring("digest", 1, 1).isin(*TUNING)))
    tuning = rows.where("NOT held")
    # counts by rule and notch, then summed up to each notch
    hits = tuning.select("stratum", "good", F.posexplode("notches").alias("rule", "notch")).groupBy("stratum", "rule", "notch").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    points = hits.groupBy("stratum", "rule").agg(F.collect_list(F.struct("notch", "g", "b")).alias("at"), F.sum("g").alias("all_g"))
    upto = lambda c, k: F.aggregate(F.filter("at", lambda x: x["notch"] <= k), F.lit(0).cast("long"), lambda a, x: a + x[c])
    steps = F.transform(F.sequence(F.lit(1), F.lit(NOTCHES)), lambda k: F.struct(upto("b", k).alias("b"), (-k).alias("milder"), upto("g", k).alias("g")))
    best = F.array_max(F.filter(steps, lambda x: (x["b"] > 0) & (x["g"] * len(RULES) <= F.col("all_g") * rate)))
    caps = points.select("stratum", "rule", F.coalesce(-best["milder"], F.lit(0)).alias("cap"))
    caps = caps.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "cap"))), lambda x: x["cap"]).alias("caps"))

    # texts that the rules see alike are one row before they meet the caps of their stratum
    held = rows.where("held AND good").groupBy("stratum", "notches").agg(F.count("*").alias("n")).join(caps, "stratum").withColumn("at", first_rejecting(F.col("notches"), F.col("caps")))
    counts = held.groupBy("stratum").agg(F.sum("n").alias("n_good"), *(F.sum(F.when(F.col("at") <= k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(1, NOTCHES + 1)))
    strata = caps.join(counts, "stratum", "left").na.fill(0)
    strata = cut(strata.select("stratum", "caps", "n_good", F.array(*(f"k{k}" for k in range(1, NOTCHES + 1))).alias("k")))
    m = max(1, strata.count())
    tested = strata.select("*", F.transform(F.sequence(F.lit(0), F.lit(NOTCHES - 1)), lambda i: binomial_tail(F.get("k", i), F.col("n_good"), rate)).alias("tails"))
    failing = F.filter(F.sequence(F.lit(1), F.lit(NOTCHES)), lambda k: F.get("tails", k - 1) > error / m)
    tested = tested.withColumn("notch", F.coalesce(F.array_min(failing) - 1, F.lit(NOTCHES)))
    at = F.greatest(F.col("notch") - 1, F.lit(0))
    return cut(tested.select("stratum", "caps", "notch", "n_good", F.when(F.col("notch") > 0, F.get("k", at)).otherwise(0).alias("n_rejected"), F.when(F.col("notch") > 0, F.get("tails", at)).otherwise(1.0).alias("p_value"), F.lit(m).alias("n_strata")))


def first_rejecting(notches: Column, caps: Column) -> Column:
    """The first notch at which some rule rejects within its cap."""
    return F.array_min(F.zip_with(notches, caps, lambda t, c: F.when(t <= c, t).otherwise(NOTCHES + 1)))


def judge(docs: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05, stratum: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, stratum and rejected_by (the first rule that rejects, else null) of every row.

    kept is false if the base rules fail, or if a rule rejects at the cutoff that its
    stratum allows (see fit). A stratum without labelled texts that pass the base rules,
    or with too few of them to prove anything, rejects nothing beyond the base rules.

    Null texts are empty: no words, base_failed. Null strata are one of their own. Null
    ids, repeated ids and repeated rows give a row each; further columns are ignored; an
    empty table gives no rows; without labels only the base rules reject. Whole texts
    are judged, however long.
    """
    stats = cut(statistics(docs, stratum, id_col, text_col))
    plan = fit(stats, labels, rate, error).select("stratum", "caps", "notch")
    if plan.count() <= FEW:
        rows = stats.join(F.broadcast(plan), "stratum", "left")
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = stats.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS))).join(salted, ["stratum", "salt"], "left")
    limit = F.coalesce(F.col("notch"), F.lit(0))
    rejects = F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda i: F.get("notches", i) <= F.least(F.get("caps", i), limit))
    rows = rows.withColumn("notches", _notches()).withColumn("which", F.when(F.col("base_failed") | (limit == 0), F.lit(0)).otherwise(F.array_position(rejects, True)))
    names = F.array(*(F.lit(r.name) for r in RULES))
    by = F.when(F.col("base_failed"), F.lit("base")).when(F.col("which") > 0, F.get(names, (F.col("which") - 1).cast("int")))
    return rows.select("doc_id", *BASE, "base_failed", by.isNull().alias("kept"), F.nullif(F.substring("stratum", 2, 1 << 30), F.lit("")).alias("stratum"), by.alias("rejected_by"))
