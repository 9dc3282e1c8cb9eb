import random
import zlib

import numpy as np
import zstandard

from tests.llm.common import docs
from weftgraph.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(d, language.fit(d)).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    test = out[out.held_out]
    assert len(out) == 1000 and (test.lang_pred == test.lang).mean() > 0.97
    clear = test[~test.rejected]
    assert (clear.lang_pred == clear.lang).mean() >= (test.lang_pred == test.lang).mean()


def test_odd_tables(spark):
    df = docs(spark, [None, "", "12 34 !!", "a", "b " * 50000, "a b c"], [0, 1, 2, 3, None, 5], extra=True)
    out = {r.doc_id: r for r in language.predict(df, language.fit(df)).collect()}
    assert [out[k].lang_pred for k in (0, 1, 2, 3, None, 5)] == ["und"] * 3 + ["en"] * 3
    assert out[0].score == 0 and out[3].score == 1
    assert {r.lang_pred for r in language.predict(df, language.fit(df.limit(0))).collect()} == {"und"}
    assert language.predict(df.limit(0), language.fit(df)).collect() == []


def texts_of(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 400))) for _ in range(n)]


def test_predictions_equal_plain_compression(spark):
    rng = random.Random(1)
    vocab = {k: ["".join(rng.choice(s) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for k, s in (("aa", "abcdef"), ("bb", "cdefgh"), ("cc", "éàxyz"))}
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate((k, t) for k, v in vocab.items() for t in texts_of(rng, v, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    contents = language.fit(df)
    assert sorted(contents) == sorted(vocab)
    for r in language.predict(df, contents, 0.01, 0.02).collect():
        b = language.letters(rows[r.doc_id][1])
        sizes = []
        for k in sorted(contents):
            d = zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(b[x : x + language.BLOCK])) for x in range(0, len(b), language.BLOCK)))
        best = min(range(3), key=lambda x: (sizes[x], x))
        rest = sorted(sizes)
        assert r.lang_pred == sorted(contents)[best] and r.rejected == (rest[1] / rest[0] - 1 < 0.01)
        assert abs(r.score - 1 / sum(np.exp(-(x / rest[0] - 1) / 0.02) for x in sizes)) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_the_sample_is_the_smallest_hashes_of_distinct_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(language, "DOCS", 5)
    rng = random.Random(2)
    texts = ["t%d %s" % (k, "x" * rng.randrange(30)) for k in range(60)]
    df = spark.createDataFrame([(k, t, "en" if k % 3 else "fr", "s", 0) for k, t in enumerate(texts)] + [(500 + k, texts[1], "en", "s", 0) for k in range(200)], SCHEMA)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = language.fit(df)
    for lang in ("en", "fr"):
        own = {t for k, t in enumerate(texts) if (k % 3 != 0) == (lang == "en") and zlib.crc32(str(k).encode()) % 4 != 2}
        own |= {texts[1]} if lang == "en" else set()
        want = sorted(own, key=hashed.get)[:5]
        assert got[lang] == language.letters("\n".join(want))


def test_a_hot_repeated_row_hides_no_language(spark):
    rng = random.Random(3)
    words = ["mot", "chose", "jour", "temps", "vie"]
    rows = [(1, "the same english row again and again", "en", "s", 0)] * 20_000 + [(k, t, "fr", "s", 0) for k, t in enumerate(texts_of(rng, words, 48), 2)]
    assert sorted(language.fit(spark.createDataFrame(rows, SCHEMA))) == ["en", "fr"]


def test_ties_go_to_the_smaller_name(spark):
    df = docs(spark, ["some words here", "other words there"])
    out = language.predict(df, {"zz": b"some words here", "aa": b"some words here"}).collect()
    assert {r.lang_pred for r in out} == {"aa"} and {r.score for r in out} == {0.5} and all(r.rejected for r in out)
