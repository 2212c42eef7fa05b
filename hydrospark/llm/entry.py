"""Registered queries of the text operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrospark.llm import chat_format, decontamination, hard_negatives, host_rules, length_histogram, ngram_join, packing, quality_classifier, secret_scan, sharding, time_encoding, toxicity, url_filter
from hydrospark.llm.sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ftrl_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_quality(docs, model)


def op2_template_decontamination(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_nnls_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_length_histogram(spark, sf_dir):
    return length_histogram.length_totals(length_histogram.length_histogram(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op6_slot_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_counterfactual_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op8_host_rules(spark, sf_dir):
    out = host_rules.judge_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_host_segmentation(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_prefix_target(spark, sf_dir):
    conversations = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.expand_targets(conversations))


def op11_ownership_secrets(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_time_encoding(spark, sf_dir):
    return time_encoding.encode(*(table(spark, sf_dir, x) for x in ("sale_lines", "sales", "items", "vendors", "clients")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ftrl_quality,
            op2_template_decontamination,
            op3_nnls_packing,
            op4_length_histogram,
            op5_ngram_jaccard,
            op6_slot_sharding,
            op7_counterfactual_toxicity,
            op8_host_rules,
            op9_host_segmentation,
            op10_prefix_target,
            op11_ownership_secrets,
            op12_hard_negatives,
            op13_time_encoding,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
