"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, extraction, language, licenses, ngram_join, packing, quality, sentencepiece_codec, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "segments")


def curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def cover_tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), ngram_join.Rule(words=3, num=90, den=100))


def template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def chunk_table_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measures(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity_segments": toxicity_segments,
        "op2_curve_packing": curve_packing,
        "op3_cover_tree_pairs": cover_tree_pairs,
        "op4_url_language_models": url_language_models,
        "op5_token_combination_join": token_combination_join,
        "op6_template_extraction": template_extraction,
        "op7_license_scan": license_scan,
        "op8_chunk_table_codec": chunk_table_codec,
        "op9_quality_rules": quality_rules,
        "op10_language_evidence": language_evidence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality.oracle_sql()}
