"""Every operator over degenerate tables: a row for each document, nothing lost, no crash."""

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.common import docs
from weftgraph.llm import decontamination, jaccard, language, mixing, quality, rules, secrets, stupid_backoff, substrings, tokens

TABLES = {
    "nulls": ([None] * 5, [None] * 5),
    "empty": (["", " ", "\n"], None),
    "one": (["a b c d e f"], None),
    "repeats": (["same words here again and again and again and once more for good measure"] * 60, [7] * 60),
    "copies": (["x y z " * 30] * 60, None),
    "long": (["w%d" % (k % 900) for k in range(3)] + [" ".join("w%d" % (k % 900) for k in range(150_000))], None),
    "odd": (["\x00", "퟿\U0010ffff", "a\x00b", "=" * 300, "AKIA" * 50, "0" * 4000], None),
}


def operators(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "a b c d e f"), (1, "x y z x y z")], "item_id long, text string")
    return {
        "secrets": secrets.scan,
        "scores": stupid_backoff.score,
        "mix": mixing.mix,
        "substrings": substrings.remove_repeats,
        "jaccard": jaccard.join,
        "quality": lambda d: quality.predict(d, quality.fit(d, labels)),
        "decontamination": lambda d: decontamination.find(d, bench),
        "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
        "language": lambda d: language.predict(d, language.fit(d)),
        "rules": lambda d: rules.judge(d, labels),
    }


@pytest.mark.parametrize("name", ["secrets", "scores", "mix", "substrings", "jaccard", "quality", "decontamination", "tokens", "language", "rules"])
def test_every_row_has_a_result(spark, name):
    f = operators(spark)[name]
    for table, (texts, ids) in TABLES.items():
        rows = f(docs(spark, texts, ids, extra=True)).collect()
        assert len(rows) == len(texts), table
        want = sorted(range(len(texts)) if ids is None else ids, key=str)
        assert sorted((r.doc_id for r in rows), key=str) == want, table


def test_copies_are_one_class_and_repeats_one_row(spark):
    for table in ("repeats", "copies"):
        d = docs(spark, *TABLES[table])
        rows = jaccard.join(d).collect()
        assert {r.n_links for r in rows} == {59} and len({r.class_id for r in rows}) == 1
        assert jaccard.keep_one(d).count() == 1
    assert jaccard.keep_one(docs(spark, *TABLES["nulls"])).count() == 5


def test_stages_over_degenerate_tables(spark):
    for table, (texts, ids) in TABLES.items():
        d = docs(spark, texts, ids)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, "/root/testdata/sf0.001").count() <= len(texts), (table, name)
