"""Corpus pipeline: documents through the operators of ``ratewise.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet in the shared folder and rereads them for the
next one, so a lost executor costs a re-read and no stage runs twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewise.llm import decontaminate, minhash, quality_rules, secret_scan, sp_sampling
from ratewise.llm.common import documents, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows that the policy rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each near-duplicate group stays (shingles of
    five words, similarity 0.8 or more)."""
    return minhash.drop_copies(docs, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a benchmark window go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets are masked in the text, and n_chars follows."""
    return secret_scan.redact(docs)


def sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sampled segmentations of every document that is left."""
    return sp_sampling.sample_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("sentencepiece", sampled),
]

#: Sampling segmentations has no SQL form; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs, f"stage-{name}")
    return docs
