"""Documents with nulls, ties, repeats and odd texts, and brute-force helpers."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "size", "score", "h", "chunk", "rid", "n", "y", "id", "t", "limit", "full", "need", "row", "g", "f1", "f2", "_key", "_h", "_f1", "_id", "_rows", "n_words", "comp", "list", "v", "part", "place", "rate", "prefix", "up", "salt", "held_out", "predicted", "spans", "a b", "c.d")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, texts, ids=None, extra=False):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators use themselves
        for c in CLASHES:
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def some_texts(rng, n=60, vocab=30, long=400):
    base = [" ".join(rng.choice(["w%d" % k for k in range(vocab)]) for _ in range(long // 4)) for _ in range(4)]
    out = [None, "", " ", "\t\n", "x", "é ü \x0b z", "a" * 5000, " ".join("w%d" % (k % vocab) for k in range(20000))]
    for k in range(n):
        kind = k % 6
        w = rng.choice(base).split()
        if kind == 0:
            out.append(" ".join(w))
        elif kind == 1:
            a = rng.randrange(len(w))
            out.append(" ".join(w[a : a + rng.randrange(60)] + ["u%d" % k] + w[:30]))
        elif kind == 2:
            w[rng.randrange(len(w))] = "edit%d" % k
            out.append("\n".join(w))
        else:
            out.append("  ".join("r%d" % rng.randrange(200) for _ in range(rng.randrange(80))))
    return out
