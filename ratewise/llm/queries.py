"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (collocations, decontaminate, hard_negatives, language_id, minhash, phrase_automata, pii_crf, quality_rules, secret_scan, sharding,
               sp_sampling, suffix_dedup, token_counts)
from .common import documents
from .sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_rows(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_rows(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_rows(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sample_rows(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.pii_rows(documents(spark, sf_dir))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.phrase_rows(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rows(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_rows(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negative_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_counts, op2_sharding, op3_suffix_dedup, op4_secret_scan, op5_sentencepiece, op6_minhash, op7_pii_crf, op8_phrase_automata,
    op9_quality_rules, op10_decontamination, op11_language_id, op12_collocations, op13_hard_negatives)}
