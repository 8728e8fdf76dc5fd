"""A corpus made ready for training: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns where each piece of each document lies in the packed sequences. Null and empty texts pass through like others
(null and empty ones are one near-duplicate group); very long texts are read whole; rows of one doc_id, or none, and
different texts are documents apart, rows equal in both are one document from near_dedup on; an empty table gives an
empty result; further columns, whatever their names, are kept throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelproof.llm import decontam, line_dedup, near_copies, packing, quality
from reelproof.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, takes for good."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document, or the same, already has."""
    return line_dedup.dedup_lines(docs).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of texts that are near copies by SimHash or by Jaccard.

    Near are fingerprints that differ in two bits at most, and sets of five-word shingles with a Jaccard of 0.8 or more (see near_copies).
    """
    return near_copies.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; of rows with one doc_id, only those go whose own text holds one."""
    held = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak"), F.col("text_key").alias("_key")).distinct()
    return docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col("_leak")) & (decontam.text_key(F.col("text")) == F.col("_key")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of the permitted lengths."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_copied_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither boosted trees nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
