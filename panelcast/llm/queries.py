"""Registered queries of this subpackage: name -> builder, and name -> DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import (chunk_dedup, langid, lookup_sharding, merkle_manifest, mixing_lm, order_minhash, pu_quality, spaced_seed,
                           splitter_trie, stable_ann, suffix_dedup, swap_packing, url_markov)
from panelcast.llm.common import table


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op4_stable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_ann.nearest_fiftieths(table(spark, sf_dir, "embeddings"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_sharding.place_documents(table(spark, sf_dir, "documents"))


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_splitter_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter_trie.conversation_nodes(table(spark, sf_dir, "conversations"))


def op12_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge_pages(table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
    "op2_order_minhash": op2_order_minhash,
    "op3_language_id": op3_language_id,
    "op4_stable_ann": op4_stable_ann,
    "op5_context_mixing": op5_context_mixing,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_lookup_sharding": op7_lookup_sharding,
    "op8_swap_packing": op8_swap_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pu_quality": op10_pu_quality,
    "op11_splitter_trie": op11_splitter_trie,
    "op12_url_markov": op12_url_markov,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_spaced_seed_decontamination": spaced_seed.ORACLE_SQL,
    "op11_splitter_trie": splitter_trie.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
