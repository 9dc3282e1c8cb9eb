import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import docs, some_texts
from weftgraph.llm.tokens import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "don't WE'LL I'd", "é é́ Å", "a b c　d", "İstanbul ΣΣ", "x\x1cy\x85z", "\U0001f600 \U0001f468‍\U0001f469", "1234 12.5% a1b2", "́ ́a", "한국어 中文 ไทย"]


def test_equals_the_library_on_whole_texts(spark):
    texts = some_texts(random.Random(1)) + ODD + ODD
    model = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_counts(docs(spark, texts, extra=True), PATH, limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), t


@pytest.mark.parametrize("texts, ids", [([], []), (["a b", "a b", None], [None, 3, 3])])
def test_odd_tables(spark, texts, ids):
    df = docs(spark, texts, ids) if texts else docs(spark, ["a"]).limit(0)
    assert sorted((r.n_tokens for r in token_counts(df, PATH).collect())) == [0, 2, 2][: len(texts)]


def test_many_chunks_give_the_same(spark, monkeypatch):
    from weftgraph.llm import packs

    texts = some_texts(random.Random(2)) + ODD
    rows = lambda: sorted(tuple(r) for r in token_counts(docs(spark, texts), PATH).collect())
    whole = rows()
    monkeypatch.setattr(packs, "CHUNK", 200)
    assert rows() == whole
