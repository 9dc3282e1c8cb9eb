import random

from tests.llm.common import docs, some_texts, words
from weftgraph.llm.mixing import mix


def targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)


def check(rows, texts):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len(words(r.text)) and r.taken in (0, r.size, 2 * r.size)
    want = targets(sizes)
    longest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s], s
    assert len(rows) == len(texts)


def test_targets_and_budgets(spark):
    texts = some_texts(random.Random(1), n=200)
    df = docs(spark, texts, extra=True)
    rows = mix(df).collect()
    check(rows, texts)
    again = {(r.doc_id, r.taken) for r in mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_a_source_of_a_third_and_sources_without_words(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(1, 50), "en", "hot" if k % 3 == 0 else f"s{k % 11}", 0) for k in range(400)] + [(None, None, None, "none", 0), (None, "", None, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(mix(df).collect(), rows)


def test_repeated_rows_are_taken_in_part(spark):
    rng = random.Random(5)
    rows = [(1, "a b c d e", "en", "hot", 0)] * 500 + [(k, "w " * rng.randrange(1, 9), "en", f"s{k % 5}", 0) for k in range(2, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mix(df).collect()
    check(got, rows)
    assert len({r.taken for r in got if r.source == "hot"}) == 2
    again = sorted((r.doc_id, r.taken) for r in mix(df.repartition(11)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)


def test_the_chosen_rows_are_those_of_the_smallest_hashes(spark):
    """All rows but one of each source follow from their hashes alone; equal to a walk in the order of hashes."""
    from pyspark.sql import functions as F

    df = docs(spark, some_texts(random.Random(6), n=150))
    got = mix(df).withColumn("hash", F.xxhash64(F.lit(7), *df.columns)).collect()
    for source in {r.source for r in got}:
        own = sorted((r for r in got if r.source == source), key=lambda r: r.hash)
        whole = own[0].source_size and int(own[0].target // own[0].source_size)
        need, done = own[0].target - whole * own[0].source_size, 0
        for r in own:
            more = r.size > 0 and done <= need and done + r.size / 2 <= need
            assert r.taken == r.size * (whole + more)
            done += r.size


def test_empty_tables_maps_and_clashing_names(spark):
    assert mix(docs(spark, ["a"]).limit(0)).collect() == []
    assert [r.taken for r in mix(docs(spark, [None, ""])).collect()] == [0, 0]
    df = docs(spark, ["a b", "c"] * 20, extra=True).selectExpr("*", "map('a', 1) AS m", "5 AS taken", "named_struct('q', map(1, 2)) AS deep")
    out = mix(df)
    assert sorted(out.columns) == sorted({*df.columns, "size", "source_size", "target", "taken"}) and out.count() == 40


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    from weftgraph.llm import mixing

    texts = some_texts(random.Random(4), n=80)
    few = {(r.doc_id, r.taken) for r in mix(docs(spark, texts)).collect()}
    monkeypatch.setattr(mixing, "FEW", 0)
    assert {(r.doc_id, r.taken) for r in mix(docs(spark, texts)).collect()} == few
