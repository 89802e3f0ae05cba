"""Toxicity: a factorisation machine over hashed terms, whose factors learn which terms are toxic only together."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.factorisation import Machine, Words, fit, in_fold, labelled_sample, score_column
from fieldlens.llm.store import documents

SIZE = 1 << 18
SAMPLE = 12_000  # most labelled rows used for fitting; they pass through the driver's memory
THRESHOLD = 0.7
EVIDENCE = 6.5  # see factorisation.fit
STEMS = (4, 5, 6)  # lengths of stems in letters

_TERM = re.compile(r"\w+")


def _forms(word: str):
    """The terms inside a white-space word, and their stems."""
    for t in _TERM.findall(word):
        yield t
        yield from (f"{t[:n]}-" for n in STEMS if len(t) > n)


class Features:
    """Distinct lower-case terms of the whole text and their stems (first letters), each with value 1; slot 0 is always on.

    Stems let inflected and compound forms of a term share what is learned.
    """

    def __init__(self, active: np.ndarray | None = None):
        self.terms = Words(SIZE - 1, 1, _forms, active)

    def __call__(self, text: str, _: float | None) -> tuple[np.ndarray, np.ndarray]:
        slots = np.concatenate([[0], self.terms.slots(set(text.lower().split()))]).astype("i8")
        return slots, np.ones(len(slots), "f4")


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bound: int = SAMPLE) -> Machine:
    """Learn ``labels.toxic`` from rows outside the held-out fold, at most ``bound`` of them."""
    rows = labelled_sample(docs, labels, "toxic", ~in_fold(F.col("id"), folds, held_out), Features, bound, None)
    return fit(rows, SIZE, least_rows=3, evidence=EVIDENCE, positive=3.0, epochs=20)


def with_toxicity(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1. Map-only; every row is scored on its whole text.

    A null text counts as empty; repeated rows get equal scores; other columns pass through (one of the same name as the score is
    replaced).
    """
    return docs.withColumn(name, score_column(machine, Features, docs.sparkSession, F.col("text"), F.lit(None)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
