"""Order-dependent recurrences of long logs as a parallel scan: step maps per slice, composed in a tree, applied on the way down."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.running import row_numbers, running_max

SLICE = 1024  # rows of one slice
FAN_IN = 64  # maps composed at once

_LIST = pa.list_(pa.float64())


class StepMap:
    """What rows do to the best value so far: ``b`` becomes ``finals[k]`` of the first ``limits[k]`` above ``b + step``, else stays."""

    def __init__(self, limits, finals):
        self.limits, self.finals = np.asarray(limits, float), np.asarray(finals, float)

    def __call__(self, b: float, step: float) -> float:
        k = int(np.searchsorted(self.limits, b + step, "right"))
        return float(self.finals[k]) if k < len(self.limits) else b

    @classmethod
    def of_rows(cls, values: np.ndarray, seen: float, step: float) -> StepMap:
        """Of rising values after rows whose maximum is ``seen``: a best value then lies within ``step`` below it, so few limits matter."""
        nxt = np.searchsorted(values, values + step, "right")
        final = values.copy()
        for k in range(len(values) - 1, -1, -1):
            if nxt[k] < len(values):
                final[k] = final[nxt[k]]
        last = int(np.searchsorted(values, seen + step, "right")) + 1
        return cls(values[:last], final[:last])

    @classmethod
    def composed(cls, maps: Sequence[StepMap], seen: float, step: float) -> StepMap:
        """One after the other."""
        limits, finals = [], []
        for k, m in enumerate(maps):
            for limit, b in zip(m.limits, m.finals):
                if limits and limits[-1] > seen + step:
                    return cls(limits, finals)
                for later in maps[k + 1:]:
                    b = later(b, step)
                limits.append(limit)
                finals.append(b)
        return cls(limits, finals)


def _maps(column: pa.Array) -> list[list[StepMap]]:
    return [[StepMap(m["limits"], m["finals"]) for m in row] for row in column.to_pylist()]


def improving_rows(log: DataFrame, group: Sequence[str], order: str, value: str, step: float, start: float = 0.0, slice_rows: int = SLICE,
                   fan_in: int = FAN_IN) -> DataFrame:
    """(group, _no, _best): the rows, by their number in ``order``, whose value beats the best so far by more than ``step``; the best starts at ``start``.

    The recurrence looks sequential, but what a slice of rows does to the best value is a step function, and such functions compose
    associatively. Slices of ``slice_rows`` rows make theirs alone, a tree with ``fan_in`` children composes them, and the best value before each
    slice comes down the same tree. A run with a third of all rows is thus spread over its slices; no task sees a whole run. Only new maxima can
    improve, and the best lies within ``step`` below the maximum seen, so a map lists only maxima in that range and one beyond.

    Null and NaN values never improve. Rows of equal ``order`` come in any order among themselves. Groups may be empty (one run).
    """
    group = list(group)
    if step < 0:
        raise ValueError("step must not be negative")
    at = [F.floor(F.col(order) / slice_rows)]
    rows = log.select(*group, order, F.when(~F.isnan(value), F.col(value).cast("double")).alias("_v"))
    numbered = row_numbers(running_max(rows, group, at, [F.col(order)], {"_max": F.col("_v")}), group, at, [F.col(order)], "_no")
    earlier = numbered.select(*group, (F.col("_no") + 1).alias("_no"), F.col("_max").alias("_prev"))
    numbered = numbered.join(earlier, [*group, "_no"], "left").withColumn("_prev", F.greatest(F.coalesce("_prev", F.lit(float("-inf"))), F.lit(start)))
    maxima = numbered.where((F.col("_v") > F.col("_prev")) & (F.col("_v") > start + step))
    key = F.struct(F.lit(0).alias("_"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]).alias("_g")
    ordered = F.sort_array(F.collect_list(F.struct("_no", "_v")))
    slices = maxima.groupBy(key, F.floor((F.col("_no") - 1) / slice_rows).alias("_node")).agg(F.min("_prev").alias("_seen"), ordered.alias("_rows"))
    slices = slices.select("_g", "_node", "_seen", F.col("_rows._no").alias("_nos"), F.col("_rows._v").alias("_vs"))
    kind = dict(slices.dtypes)["_g"]
    maps = f"_g {kind}, _node bigint, _seen double, _map struct<limits: array<double>, finals: array<double>>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [StepMap.of_rows(np.array(v), s, step) for v, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield _with_maps(b, made)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _with_maps(b, [StepMap.composed(m, s, step) for m, s in zip(_maps(b.column(2)), b.column(3).to_pylist())])

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, node, best = [], [], []
            for i, (nodes, ms, x) in enumerate(zip(b.column(1).to_pylist(), _maps(b.column(2)), b.column(3).to_pylist())):
                for n, m in zip(nodes, ms):
                    take.append(i), node.append(n), best.append(x)
                    x = m(x, step)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(node, pa.int64()), pa.array(best, pa.float64())],
                                             names=["_g", "_node", "_in"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, no, best = [], [], []
            for i, (nos, values, x) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                v = np.array(values)
                while (k := int(np.searchsorted(v, x + step, "right"))) < len(v):
                    x = values[k]
                    take.append(i), no.append(nos[k]), best.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(no, pa.int64()), pa.array(best, pa.float64())],
                                             names=["_g", "_no", "_best"])

    # The height of the tree follows the longest run, at most the number of rows of the log.
    longest = -(-log.groupBy(*group).count().agg(F.max("count")).first()[0] // slice_rows) if not log.isEmpty() else 1
    tree, width = [], longest
    level = slices.select("_g", "_node", "_vs", "_seen").mapInArrow(own, maps)
    while width > 1:
        child = F.sort_array(F.collect_list(F.struct("_node", "_map", "_seen")))
        parents = level.groupBy("_g", F.floor(F.col("_node") / fan_in).alias("_up")).agg(child.alias("_c"), F.min("_seen").alias("_seen"))
        parents = parents.select("_g", F.col("_up").alias("_node"), F.col("_c._node").alias("_nodes"), F.col("_c._map").alias("_maps"), "_seen")
        tree.append(parents)
        level = parents.select("_g", "_node", "_maps", "_seen").mapInArrow(joined, maps)
        width = -(-width // fan_in)
    best = level.select("_g", "_node", F.lit(float(start)).alias("_in"))
    for parents in reversed(tree):
        told = parents.join(best, ["_g", "_node"]).select("_g", "_nodes", "_maps", "_in")
        best = told.mapInArrow(handed, f"_g {kind}, _node bigint, _in double")
    found = slices.join(best, ["_g", "_node"]).select("_g", "_nos", "_vs", "_in").mapInArrow(marked, f"_g {kind}, _no bigint, _best double")
    return found.select(*[F.col(f"_g.g{i}").alias(g) for i, g in enumerate(group)], "_no", "_best")


def _with_maps(batch: pa.RecordBatch, made: list[StepMap]) -> pa.RecordBatch:
    pair = pa.StructArray.from_arrays([pa.array([m.limits for m in made], _LIST), pa.array([m.finals for m in made], _LIST)], names=["limits", "finals"])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pair], names=["_g", "_node", "_seen", "_map"])
