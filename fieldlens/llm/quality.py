"""Quality classifier: a factorisation machine over hashed words, structure statistics and the character count."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.factorisation import KEPT, Machine, Words, fit, in_fold, labelled_sample, score_column
from fieldlens.llm.store import documents

WORD_BUCKETS = 1 << 17
STATS, BINS = 24, 16
SIZE = WORD_BUCKETS + STATS * BINS
SAMPLE = 12_000  # most labelled rows used for fitting
THRESHOLD = 0.3

COMMON = ("the", "and", "of", "de", "la", "und", "die", "que")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _bin(value: float, scale: float) -> int:
    """Bin of a share or a logarithm; the last bin takes the rest."""
    return min(BINS - 1, max(0, int(value * scale)))


class _Counts(dict):
    """Letters, digits, all-capital words and common words of one word, packed into one number so that sums stay in C."""

    def __missing__(self, word: str) -> int:
        letters, digits = sum(map(len, _LETTERS.findall(word))), sum(map(len, _DIGITS.findall(word)))
        self[word] = out = letters | digits << 40 | word.isupper() << 80 | (word.lower() in COMMON) << 120
        return out


class Features:
    def __init__(self, active: np.ndarray | None = None):
        self.words = Words(WORD_BUCKETS, STATS * BINS, active=active)
        self.counts = _Counts()

    def __call__(self, text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n, size, dense = len(words), len(text), sum(map(len, words))
        distinct = set(text.lower().split())
        if len(self.counts) > KEPT:
            self.counts.clear()
        packed = sum(map(self.counts.__getitem__, words))
        letters, digits, upper, common = (packed >> k & (1 << 40) - 1 for k in (0, 40, 80, 120))
        lines = text.split("\n")
        filled = [x for x in lines if x.strip()]
        stops = text.count(".") + text.count("!") + text.count("?")
        share = lambda a, b: a / b if b else 0.0
        log = lambda x: math.log2(1 + x)
        odd = dense - letters
        stats = (
            _bin(log(n), 1), _bin(log(size), 0.8), _bin(share(letters, dense), 30 / 2), _bin(share(upper, n), 15),
            _bin(share(odd, dense), 40), _bin(share(dense, n), 1), _bin(share(len(distinct), n), 15),
            _bin(log(len(lines)), 2), _bin(share(len(set(filled)), len(filled)), 15), _bin(log(share(n, len(filled))), 2),
            _bin(log(share(n, stops)), 2.5), _bin(share(digits, size), 60), _bin(share(size - dense, size), 40),
            _bin(share(text.count("!"), n), 15), _bin(share(text.count("|"), n), 30), _bin(share(text.count(","), n), 60),
            _bin(log(max(map(len, words), default=0)), 2), _bin(share(common, n), 60),
            BINS - 1 if n_chars is None or n_chars != n_chars else _bin(log(max(0.0, n_chars)), 0.75),
            0 if n_chars is None or n_chars != n_chars else 1 + _bin(abs(n_chars - size) / (1 + size), 10) % (BINS - 1),
        )
        slots = self.words.slots(distinct)
        fixed = np.arange(len(stats)) * BINS + np.array(stats)
        values = np.full(len(fixed) + len(slots), 1.0, "f4")
        values[len(fixed):] = 1.0 / math.sqrt(max(1, len(distinct)))
        return np.concatenate([fixed, slots]).astype("i8"), values


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, bound: int = SAMPLE) -> Machine:
    """Learn ``labels.quality`` from rows outside the held-out fold, at most ``bound`` of them."""
    rows = labelled_sample(docs, labels, "quality", ~in_fold(F.col("id"), folds, held_out), Features, bound,
                           "n_chars" if "n_chars" in docs.columns else None)
    return fit(rows, SIZE)


def with_quality(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1. Map-only; every row is scored on its whole text.

    A null text counts as empty; a null or missing n_chars has a bin of its own; repeated rows get equal scores; other columns pass
    through (one of the same name as the score is replaced).
    """
    meta = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.withColumn(name, score_column(machine, Features, docs.sparkSession, F.col("text"), meta))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
