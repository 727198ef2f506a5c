"""Corpus pipeline: quality rules, near-dedup, suffix dedup, mixing, packing, each over what the one before kept.

All stages take null ids, sources, languages and texts, repeated rows and ids, and tables without rows; all but the last return the
input's columns, further ones with their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import minhash, mixing, packing, quality, suffixes
from pixelframe.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words and go; repeated rows are judged alike."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, nulls last.

    Rows with one id are told apart by their texts; of equal rows one stays, and every text without words.
    """
    return minhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of over 50 words; the first copy, by doc_id, stays. n_chars counts the new text.

    Words are runs without white space, of any length. Null texts stay null, a text that goes whole becomes empty.
    """
    return suffixes.remove_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic targets: mixing.TARGETS, tempered shares where they name none.

    Null sources and languages are values of their own; a row is drawn by a hash of its values, so repeated rows stay or go together.
    """
    targets = spark.createDataFrame(mixing.TARGETS, "dimension string, value string, share double")
    return mixing.sampled(docs, targets)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 1024. A null or empty text is one piece with the end id only."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can express neither the raking nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
