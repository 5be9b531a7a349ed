"""Registered queries of the training-data operators: thin digests of each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgecast.llm.decontaminate import contaminated
from forgecast.llm.licenses import license_scan
from forgecast.llm.merkle import merkle_audit
from forgecast.llm.ngram_join import ngram_jaccard_join, ngram_link_counts
from forgecast.llm.oracles import (
    license_sql,
    merkle_sql,
    ngram_join_sql,
    ngram_links_sql,
    quality_sql,
    suffix_sql,
    trie_sql,
)
from forgecast.llm.paragraphs import repeated_paragraphs
from forgecast.llm.piece_codec import codec_digest
from forgecast.llm.prefix_trie import conversation_trie
from forgecast.llm.quality import quality_rules
from forgecast.llm.sharding import shard_rows
from forgecast.llm.suffix_runs import suffix_dedup
from forgecast.llm.token_counts import token_counts
from forgecast.llm.toxicity import toxicity_scores
from forgecast.llm.url_lists import ORACLE as URL_ORACLE
from forgecast.llm.url_lists import listed, page_captures, page_list_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return listed(page_captures(pages), page_list_events(pages))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_ngram_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_link_counts(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_sharding": op4_sharding,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece_codec": op7_sentencepiece_codec,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op10_ngram_link_counts": op10_ngram_link_counts,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op3_url_filters": URL_ORACLE,
    "op8_license_scan": license_sql(),
    "op10_ngram_jaccard_join": ngram_join_sql(),
    "op10_ngram_link_counts": ngram_links_sql(),
    "op11_suffix_dedup": suffix_sql(),
    "op12_conversation_trie": trie_sql(),
    "op13_merkle_manifest": merkle_sql(),
}
