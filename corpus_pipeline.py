"""The corpus pipeline: quality rules, near-duplicates, repeated passages,
source mixing and tokens, over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder as Parquet and reads it back as the next stage's docs.
All stages but the last return the columns of ``docs``, whatever they are.

Defined results, beside those of the operators: a document with a null text has
no words and is rejected by the first stage; rows without an id pass near-dedup
as one component by fingerprint, keep their passages, and are mixed like others;
of repeated rows near-dedup keeps one; a document is as often in the mix as its
source's target asks; an empty table gives an empty result with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    from neurotab.llm.quality import clean

    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    from neurotab.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    from neurotab.llm.substring import deduplicate

    return deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    from neurotab.llm.mixing import apply_mix

    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids."""
    from neurotab.llm.sentencepiece import tokenize

    return tokenize(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

# XXH64, suffix trees and SentencePiece have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from neurotab.llm.common import write_scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
