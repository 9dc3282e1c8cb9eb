import corpus_pipeline
from tests.llm.test_jaccard import brute
from weftgraph.llm import decontamination, quality, secrets

DIR = "/root/testdata/sf0.001"


def test_stages_equal_their_operators(spark):
    docs, labels, bench = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = corpus_pipeline.run(spark, DIR).toPandas().set_index("doc_id")
    good = quality.predict(docs, quality.fit(docs, labels)).where("predicted = 1").select("doc_id")
    kept = docs.join(good, "doc_id").toPandas()
    rows = list(zip(kept.doc_id.tolist(), kept.text, strict=True))
    ids = {i for i, c, _ in brute(rows) if i == c}
    d = docs.where(docs.doc_id.isin(list(ids)))
    clean = {r.doc_id for r in decontamination.find(d, bench).where("NOT contaminated").collect()}
    d = d.where(d.doc_id.isin(list(clean)))
    text = {r.doc_id: r.text for r in secrets.redact(d, secrets.thresholds(secrets.inspect(d))).collect()}
    assert set(got.index) <= clean and len(got) > 0.4 * len(clean)
    assert all(text[i] == t for i, t in got.text.items())
    assert (got.n_chars == got.text.str.len()).all() and {"doc_id", "text", "lang", "source", "n_chars", "taken"} <= {"doc_id", *got.columns}


def test_stage_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert set(stage(spark, docs.limit(0), DIR).columns) >= set(docs.columns), name
        assert stage(spark, docs.limit(0), DIR).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert stage(spark, docs, DIR).columns == docs.columns


def test_stages_take_clashing_columns_nulls_and_repeats(spark):
    from tests.llm.common import docs, some_texts

    import random

    df = docs(spark, some_texts(random.Random(1), n=30), extra=True)
    df = df.unionByName(df.limit(3)).unionByName(df.selectExpr("CAST(NULL AS long) AS doc_id", *(f"`{c}`" for c in df.columns[1:])).limit(2))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, DIR)
        assert (out.columns == df.columns) if k < len(corpus_pipeline.STAGES) - 1 else set(out.columns) >= set(df.columns), name
        assert out.count() <= df.count()


def test_run_leaves_one_folder(spark):
    import os

    from weftgraph.operators.checkpoints import folder

    at = folder(spark).removeprefix("file:")
    held = {x for x in os.listdir(at) if x.startswith("pipeline-")}
    assert corpus_pipeline.run(spark, DIR).count() > 0
    assert len({x for x in os.listdir(at) if x.startswith("pipeline-")} - held) == 1
