"""Corpus pipeline: toxic documents out, near duplicates down to one, benchmark leaks out, sources mixed, rows sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trustlake.llm import hilbert, mixing, ordinal, prefixjoin, templates
from trustlake.llm.common import stage, table
from trustlake.llm.queries import hilbert_dims


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under one half; the model learns from the labelled ones among them."""
    model = ordinal.fit_severity(ordinal.training_rows(docs, table(spark, sf_dir, "labels")))
    return ordinal.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by five-word shingles at similarity 0.8."""
    return prefixjoin.keep_first(docs, percent=80, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a template window of a benchmark item."""
    return templates.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the water-filled mix takes them."""
    return mixing.repeat_rows(docs, mixing.mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mixed corpus along the curve."""
    return hilbert.hilbert_shards(docs, hilbert_dims(), shards=16, law="bytes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: The toxicity model is fitted, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
