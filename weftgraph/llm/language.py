"""Language by compression with a dictionary of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.quality import held_out
from weftgraph.operators.checkpoints import cut

#: Documents of each language that its dictionary is drawn from, characters of each, and bytes of the dictionary, at most.
DOCS, CHARS, BYTES = 400, 400, 112 << 10
#: Languages that are learned, at most: those with most texts.
LANGUAGES = 1000
#: Text is encoded in blocks of so many bytes, each from the dictionary alone.
BLOCK = 2048
#: Compression level; from about here on the short syllables that tell languages apart are found.
LEVEL = 7
#: ASCII marks and digits say nothing about the language.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'")


def letters(text: str) -> bytes:
    """What is encoded of a text: all of it in lower case, without ASCII marks and digits."""
    return text.lower().encode("utf-8", "replace").translate(None, _MARKS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary contents of each language among the rows outside the held-out fold.

    The sample is bounded: of each language's distinct texts those DOCS with the
    smallest hashes, and a passage of CHARS characters of each, at a place that the
    hash gives. So a text that many rows repeat counts once, and a language with any
    text is learned. Rows without text, language or id are left out.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("h")).where(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0) & ~held_out(F.col(id_col))
    )
    hashes = cut(rows.select("lang", "h").distinct())
    most = cut(hashes.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))

    def smallest(spare: float) -> DataFrame:
        """The DOCS smallest hashes of each language; only as many are compared as hold them if hashes are spread evenly."""
        part = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= DOCS * spare + 50
        nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
        return hashes.join(F.broadcast(most), "lang").where(part).withColumn("nth", nth).where(F.col("nth") <= DOCS).select("lang", "h")

    some = cut(smallest(2.0))
    if some.count() < (most.agg(F.sum(F.least("n", F.lit(DOCS)))).first()[0] or 0):
        some = cut(smallest(float("inf")))
    place = F.pmod(F.shiftright("h", 31), F.greatest(F.lit(1), F.length("t") - CHARS)).cast("int") + 1
    passages = rows.join(F.broadcast(some), ["lang", "h"]).select("lang", "h", F.col("t").substr(place, F.lit(CHARS)).alias("t"))
    got = passages.groupBy("lang", "h").agg(F.min("t").alias("t")).toPandas()
    out = {}
    for lang, own in got.groupby("lang"):
        out[lang] = letters("\n".join(own.sort_values(["h", "t"]).t.drop_duplicates()))[-BYTES:] or b" "
    return out


def _encoders(contents: dict[str, bytes]) -> list:
    out = []
    for c in contents.values():
        d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def predict(docs: DataFrame, contents: dict[str, bytes], margin: float = 0.01, spread: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row.

    The whole text is encoded with each language's dictionary, block by block; the
    smallest total wins, ties to the smaller name. score is 1 for a clear case and
    1 / languages for a draw; rejected tells that the runner-up is less than margin
    larger. Null texts, texts without a letter, and all texts if no language was
    learned, are `und` with score 0 and rejected. Null ids aren't held out; repeated
    rows give a row each; further columns are ignored; an empty table gives no rows.
    """
    contents = dict(sorted(contents.items()))
    names, shared = list(contents), docs.sparkSession.sparkContext.broadcast(contents)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = _encoders(shared.value)
        for pdf in it:
            langs, scores, doubts = [], [], []
            for t in pdf.t:
                if not names or t is None or not any(map(str.isalpha, t)):
                    langs.append("und")
                    scores.append(0.0)
                    doubts.append(True)
                    continue
                b = letters(t)
                blocks = [b[k : k + BLOCK] for k in range(0, len(b), BLOCK)]
                sizes = np.array([sum(len(e.compress(x)) for x in blocks) for e in encoders], float)
                over = sizes / sizes.min() - 1
                langs.append(names[int(sizes.argmin())])
                scores.append(float(1 / np.exp(-over / spread).sum()))
                doubts.append(bool(len(over) > 1 and np.sort(over)[1] < margin))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": pdf.held_out, "lang_pred": langs, "score": scores, "rejected": doubts})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
