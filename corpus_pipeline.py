"""Corpus pipeline: each stage reads what its predecessor kept, written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``.
Nulls in any column, empty and long texts, repeated rows, empty tables and extra columns are handled as the
operators' docstrings say; extra columns travel along to the last stage, which returns its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contentflow.llm import bag_minhash, bpe, decontaminate, exact_dedup, toxicity
from contentflow.llm.common import read, save


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the model learns from ``labels`` and the documents at hand."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of those with the same text; white space runs count as one space."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates."""
    return bag_minhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth of the words lies in shared windows of ``benchmark`` items."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document: number of its token ids, their digest and that of what they decode to."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, P.PATTERN), path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: Classifier, signatures and BPE cannot be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
