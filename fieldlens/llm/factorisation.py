"""Factorisation machine on hashed features: pairwise interactions at linear cost through the sum-of-squares identity."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.store import drop, written

#: Featuriser: (text, metadata value) -> (slots int64, values float32), each slot once.
Featurise = Callable[[str, float | None], tuple[np.ndarray, np.ndarray]]


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + 1/2 sum_f ((V_f.x)^2 - (V_f^2).(x^2)))."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def active(self) -> np.ndarray:
        return (self.weights != 0) | self.factors.any(axis=1)

    def logits(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows are runs of (slot, value) beginning at ``starts``; every row has at least one feature."""
        xv = self.factors[slots] * values[:, None]
        linear = np.add.reduceat(self.weights[slots] * values, starts)
        total = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, rank: int = 8, epochs: int = 12, rate: float = 0.1,
        l2: float = 1e-5, l2_factors: float = 1e-4, least_rows: int = 3, evidence: float = 0.0, positive: float = 1.0, batch: int = 128, seed: int = 7) -> Machine:
    """AdaGrad over a bounded sample held in memory. Slots met in fewer than ``least_rows`` rows keep weight 0.

    ``positive`` is the weight of a row of class 1. Slots do so too whose share of class 1 differs too little from that of all rows: rows times Kullback-Leibler divergence below ``evidence``.

    Without rows, or with one class only, the machine answers the smoothed share of class 1 everywhere.
    """
    rng = np.random.default_rng(seed)
    y = np.array([r[2] for r in rows], dtype="f8")
    weight = np.where(y > 0, positive, 1.0)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(size, "f4"), np.zeros((size, rank), "f4"))
    if len(set(y)) < 2:
        return m
    seen, ones = np.zeros(size, "i8"), np.zeros(size, "i8")
    for slots, _, label in rows:
        seen[slots] += 1  # a row has each slot once
        if label:
            ones[slots] += 1
    share, all_share = np.clip(ones / np.maximum(seen, 1), 1e-9, 1 - 1e-9), y.mean()
    told = seen * (share * np.log(share / all_share) + (1 - share) * np.log((1 - share) / (1 - all_share)))
    used = np.flatnonzero((seen >= least_rows) & (told >= evidence))
    compact = np.full(size, -1, "i4")
    compact[used] = np.arange(len(used))
    data = []
    for slots, values, _ in rows:
        ok = compact[slots] >= 0
        data.append((compact[slots[ok]], values[ok]))
    w, v = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), rank))
    gw, gv, gb, b = np.full(len(used), 1e-2), np.full((len(used), rank), 1e-2), 1e-2, m.bias
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            picked = [i for i in order[at:at + batch] if len(data[i][0])]
            if not picked:
                continue
            slots = np.concatenate([data[i][0] for i in picked])
            x = np.concatenate([data[i][1] for i in picked]).astype("f8")
            sizes = np.array([len(data[i][0]) for i in picked])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(picked)), sizes)
            xv = v[slots] * x[:, None]
            total = np.add.reduceat(xv, starts, axis=0)
            z = b + np.add.reduceat(w[slots] * x, starts) + 0.5 * ((total ** 2).sum(1) - np.add.reduceat((xv ** 2).sum(1), starts))
            g = weight[picked] * (sigmoid(z) - y[picked]) / len(picked)
            u, at_u = np.unique(slots, return_inverse=True)
            gx = g[row] * x
            dw = np.bincount(at_u, gx, len(u)) + l2 * w[u]
            pull = gx[:, None] * (total[row] - xv)
            dv = np.stack([np.bincount(at_u, pull[:, f], len(u)) for f in range(rank)], axis=1) + l2_factors * v[u]
            gw[u] += dw ** 2
            gv[u] += dv ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.5 * rate * dv / np.sqrt(gv[u])
            gb += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(gb)
    m.bias, m.weights[used], m.factors[used] = float(b), w.astype("f4"), v.astype("f4")
    return m


READ_ROWS = 500  # sample rows that the driver reads back at once
KEPT = 150_000  # words that a worker remembers; workers share the memory beside the heap


class Words(dict):
    """Slots of a word by a fixed hash, remembered per worker up to a bound: {word: (slot, ...)}.

    ``forms`` gives the strings of a word that have slots; with ``active`` (a mask) slots outside it are left out.
    """

    def __init__(self, buckets: int, offset: int, forms=lambda w: (w,), active: np.ndarray | None = None):
        super().__init__()
        self.buckets, self.offset, self.forms, self.active = buckets, offset, forms, active

    def __missing__(self, word: str) -> tuple[int, ...]:
        slots = {self.offset + zlib.crc32(f.encode("utf-8", "replace")) % self.buckets for f in self.forms(word)}
        out = self[word] = tuple(s for s in slots if self.active is None or self.active[s])
        return out

    def slots(self, words) -> np.ndarray:
        """Distinct slots of the words, ascending."""
        if len(self) > KEPT:
            self.clear()
        found = set().union(*map(self.__getitem__, words))
        out = np.fromiter(found, "i8", len(found))
        out.sort()
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, featurise: Callable[..., Featurise], bound: int,
                    meta: str | None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most ``bound`` labelled rows, chosen by a hash of the id, alike on every run.

    ``bound`` limits the labels before the join, so the broadcast side has a proven size, and the joined rows after it (repeated
    ids could multiply them). Rows without an id, a label or with a label other than 0 or 1 are not used. The rows are written to the shared
    folder and read back some at a time, so that the driver holds them once, as the arrays that ``fit`` takes.
    """
    picked = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn).distinct()
              .orderBy(F.xxhash64("id"), "id", "label").limit(bound))
    value = F.col(meta).cast("double") if meta else F.lit(None).cast("double")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), value.alias("meta"))

    def run(batches):
        f = featurise()
        for b in batches:
            out = [f(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array([s.astype("<i4").tobytes() for s, _ in out], pa.binary()),
                 pa.array([x.astype("<f4").tobytes() for _, x in out], pa.binary())], names=["id", "label", "slots", "vals"])

    joined = texts.join(F.broadcast(picked), "id").select("id", "text", "meta", "label")
    rows = joined.mapInArrow(run, "id bigint, label int, slots binary, vals binary").orderBy(F.xxhash64("id"), "id", "label", "slots", "vals").limit(bound)
    held = written(rows.withColumn("at", F.monotonically_increasing_id()), "sample", maxRecordsPerFile=READ_ROWS)
    read = {r["at"]: (np.frombuffer(r.slots, "<i4"), np.frombuffer(r.vals, "<f4"), r.label) for r in held.toLocalIterator()}
    drop(held)
    return [read[at] for at in sorted(read)]


def score_column(machine: Machine, featurise: Callable[..., Featurise], spark, text: Column, meta: Column) -> Column:
    """Column of scores of ``text`` (null: empty) in Arrow batches; the machine's size is fixed by its parameters."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series, metas: pd.Series) -> pd.Series:
        held = shared.value
        if not hasattr(held, "features"):  # one per worker, so that known words stay
            held.features = featurise(held.active())
        f, out = held.features, np.empty(len(texts))
        made, at, size = [], 0, 0
        for i, (t, m) in enumerate(zip(texts, metas)):
            made.append(f(t, m))
            size += len(made[-1][0])
            if size > 100_000 or i + 1 == len(out):
                starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in made])[:-1]])
                z = held.logits(np.concatenate([s for s, _ in made]), np.concatenate([x for _, x in made]), starts)
                out[at:i + 1] = sigmoid(z.astype("f8"))
                made, at, size = [], i + 1, 0
        return pd.Series(out)

    return score(F.coalesce(text, F.lit("")), meta.cast("double"))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text has remainder ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(False))
