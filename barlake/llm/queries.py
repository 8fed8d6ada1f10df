"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barlake.llm import (bond_negatives, byte_bpe, chunk_dedup, conversation_repair, decontaminate, divide_skip, language_id,
                         multi_index, neighbour_quality, order_minhash, site_style_tree, suffix_dedup, token_counts)
from barlake.llm.shared import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(load(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(load(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.report(load(spark, sf_dir, "pages"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(load(spark, sf_dir, "documents"))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_quality.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(load(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.digests(load(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(load(spark, sf_dir, "conversations"))


def op12_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide_skip.report(load(spark, sf_dir, "documents"))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond_negatives.mine(load(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_suffix_dedup, op2_language_id, op3_token_counts, op4_site_style_tree, op5_order_minhash,
    op6_neighbour_quality, op7_byte_bpe, op8_multi_index, op9_decontaminate, op10_chunk_dedup,
    op11_conversation_repair, op12_divide_skip, op13_bond_negatives)}
