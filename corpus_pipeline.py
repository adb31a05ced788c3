"""The corpus pipeline: each stage works on all that the one before kept.

Every stage but the last gives the columns of ``documents``, extra ones of any name included; an empty table gives an empty table. Null ids are
rows like others. What each stage does with the rest is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import bpe, common, exact_dedup, mixing, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go.

    A null or empty text has no words and goes; rows of one text share a verdict, repeated rows all stay or all go; a text of any length is
    judged whole. Without labels of both classes only the base rule rejects.
    """
    return quality_rules.accepted(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest as it is written, then the smallest id (null last).

    Null and empty texts are equal; a row that is repeated stays once.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of three-word runs within three bits, directly or by others) stays: that with
    the smallest id (null last). Texts without words are one group.
    """
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a document taken k times is k rows, one not taken is none.

    Null is a source of its own; a text without words has size 0 and is taken as its source's other small documents are, and a source
    without any words is not taken. Rows that share id, text and source are taken equally often.
    """
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of every text, and digests of its ids and of the text they decode to. A null text has none; repeated rows repeat."""
    return bpe.digests(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again. What a stage has used goes when
    its rows are written, and these go when the next stage's are."""
    to, docs = common.shared_dir(spark), common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), f"{to}/{k}")
        if k:
            common.remove(spark, f"{to}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning and sampling stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None
