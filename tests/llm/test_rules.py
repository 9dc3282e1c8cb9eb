import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.common import docs, some_texts, words
from weftgraph.llm import rules


def base(text):
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, r in enumerate(zip(w, w[1:], w[2:])) if runs[r] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_statistics(spark):
    texts = [*some_texts(random.Random(3)), "a a a a a", "a b c a b c", "x\n\ny\nx\n \nx", "#$ | <>&*%\U0001f600", " \xa0x ", "a b c"]
    got = {r.doc_id: r for r in rules.judge(docs(spark, texts, extra=True), labels_of(spark, [])).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert tuple(got[i][c] for c in rules.BASE) == want, i
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed)


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 20, 21, 300, 5000) for k in (0, 1, 3, 14, 200) if k <= n for p in (0.05, 0.2)]
    for p in (0.05, 0.2):
        df = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long").withColumn("tail", rules.binomial_tail(F.col("k"), F.col("n"), p))
        for r in df.collect():
            exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)) if r.n <= 300 else None
            if r.k >= r.n * p:
                assert r.tail == 1
            elif exact is not None:
                assert abs(r.tail - exact) <= 1e-9 * exact


def planted(rng, n):
    """Texts and labels: good prose, shouted and marked junk, and good texts of a stratum whose prose holds marks."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts, langs, quality = [], [], []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(60, 90))]
        bad = k % 6 == 0
        lang = ("en", "de", None)[k % 3 if k % 6 else rng.randrange(3)]
        if bad:
            w = [x + "$$$" for x in w] if k % 12 else [x.upper() + "!!" for x in w]
        elif lang == "de":
            w = [x + "$$$" for x in w]  # marks mean nothing there
        texts.append(" ".join(w))
        langs.append(lang)
        quality.append(0 if bad else 1)
    return texts, langs, quality


def judged(spark, texts, langs, quality):
    d = spark.createDataFrame([(i, t, x, "s", len(t)) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    lab = labels_of(spark, [(i, q, 0) for i, q in enumerate(quality)])
    return d, lab, {r.doc_id: r for r in rules.judge(d, lab).collect()}


def test_bad_texts_go_and_no_stratum_loses_good_ones(spark):
    texts, langs, quality = planted(random.Random(5), 1500)
    _, _, got = judged(spark, texts, langs, quality)
    for lang in ("en", "de", None):
        good = [got[i].kept for i in range(1500) if quality[i] and langs[i] == lang]
        assert good.count(False) <= 0.05 * len(good), lang
    bad = [got[i].kept for i in range(1500) if not quality[i] and langs[i] != "de"]
    assert bad.count(True) <= 0.05 * len(bad)
    assert all(got[i].rejected_by == "capitals" or got[i].rejected_by == "marks" for i in range(1500) if not quality[i] and langs[i] == "de" and not got[i].kept)


def test_few_labels_or_copies_prove_nothing(spark):
    texts, langs, quality = planted(random.Random(6), 90)
    _, _, got = judged(spark, texts, langs, quality)
    assert all(r.kept for r in got.values())
    texts, langs, quality = texts * 20, langs * 20, quality * 20
    _, _, got = judged(spark, texts, langs, quality)  # copies count once
    assert all(r.kept for r in got.values())


def test_false_rejection_is_limited_over_many_draws(spark):
    """With a rule that rejects good and bad alike, a step is allowed in few draws only."""
    rng, allowed = random.Random(8), 0
    draws, n = 60, 200
    rows = [(f"s{d}", n, [sum(rng.random() < 0.05 for _ in range(n))]) for d in range(draws) for _ in (0,)]
    df = spark.createDataFrame(rows, "s string, n long, k array<long>").withColumn("tail", rules.binomial_tail(F.get("k", F.lit(0)), F.col("n"), 0.05))
    allowed = sum(r.tail <= 0.05 / draws for r in df.collect())
    assert allowed <= 3


def test_degenerate_tables(spark):
    lab = labels_of(spark, [(None, 1, 0), (1, None, 0), (0, 1, 0), (0, 0, 0)])
    assert rules.judge(docs(spark, []), lab).count() == 0
    got = rules.judge(docs(spark, [None, "", " \n", "a " * 20000], [None, None, 0, 0], extra=True), lab).collect()
    assert len(got) == 4 and not any(r.kept for r in got)
    d = docs(spark, ["a b c"] * 4, [7] * 4)
    assert rules.judge(d, lab, stratum=None).count() == 4
    few = rules.FEW
    try:
        rules.FEW = -1  # the join by shuffle gives the same rows
        texts, langs, quality = planted(random.Random(5), 600)
        _, _, a = judged(spark, texts, langs, quality)
    finally:
        rules.FEW = few
    assert a == judged(spark, texts, langs, quality)[2]


def test_the_path_has_no_python(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rules.statistics(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
