"""The queries of this subpackage: each applies an operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, jaccard, language, mixing, neighbours, oracles, quality, ranking, repair, rules, secrets, stupid_backoff, substrings, tokens

#: File of the vocabulary whose tokens op9 counts.
VOCABULARY = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff.score(_read(spark, sf_dir, "documents"))
    return out.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents")).drop("repeats")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_links")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scans, op2_lm_scores, op3_source_mix, op4_substring_dedup, op5_ngram_jaccard, op6_quality, op7_neighbours, op8_decontamination, op9_token_counts, op10_language_id, op11_ranked_search, op12_quality_rules, op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_lm_scores": oracles.LM_SCORES, "op4_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_ngram_jaccard": oracles.NGRAM_JACCARD, "op11_ranked_search": oracles.RANKED_SEARCH, "op12_quality_rules": oracles.quality_rules()}
