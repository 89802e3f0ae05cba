"""Corpus pipeline: quality, toxicity, line dedup, near-duplicate removal, packing; each stage reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.lines import dedup_lines
from fieldlens.llm.minhash import near_duplicates
from fieldlens.llm.packing import VOCABULARY, pack_documents
from fieldlens.llm.quality import THRESHOLD as GOOD
from fieldlens.llm.quality import fit_quality, with_quality
from fieldlens.llm.store import documents, written
from fieldlens.llm.toxicity import THRESHOLD as TOXIC
from fieldlens.llm.toxicity import fit_toxicity, with_toxicity
from fieldlens.session import ship_package

_SCORE = "__score"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: score at or above its threshold.

    Null and empty texts are scored from what they lack; rows of equal text and length score alike, so ties and repeated rows stay or go together; an
    empty table gives no rows. Other columns pass through; a column named ``__score`` would be lost.
    """
    ship_package(spark)
    return with_quality(docs, fit_quality(docs, _labels(spark, sf_dir)), _SCORE).where(F.col(_SCORE) >= GOOD).drop(_SCORE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts: score below its threshold.

    Null and empty texts are scored from what they lack; rows of equal text score alike, so ties and repeated rows stay or go together; an empty table
    gives no rows. Other columns pass through; a column named ``__score`` would be lost.
    """
    ship_package(spark)
    return with_toxicity(docs, fit_toxicity(docs, _labels(spark, sf_dir)), _SCORE).where(F.col(_SCORE) < TOXIC).drop(_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; those with nothing left go.

    Null and empty texts and texts of blank lines stay as they are; ties and repeated rows follow ``line_decisions``: the smallest id is the earliest, null
    last, and rows of equal id and text are treated alike; an empty table gives no rows. Other columns pass through; columns
    named ``__gone``, ``__id``, ``__hash`` or ``__text_hash`` are not allowed.
    """
    return dedup_lines(docs)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Rows that repeat an id stay or go together.

    Null and empty texts and null ids stay; an empty table gives no rows. Other columns pass through; a column named ``__id`` is not allowed.
    """
    ship_package(spark)
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids. A null or empty text is the end id alone; repeated rows are documents of their own; an empty table gives no rows."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("packing", packing)]

#: The classifiers are fitted by gradient steps, which SQL can't express; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
