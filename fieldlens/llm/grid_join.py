"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.components import connected_components
from fieldlens.llm.store import written
from fieldlens.llm.vectors import matrix, one_per_id, usable

LEADING = 8  # principal dimensions of the grid
INTERVAL = 1024  # most vectors in one sequence interval
LEAF = 64
SAMPLE = 8192  # vectors that the principal dimensions are fitted on; results do not depend on it

_BLOCK = "label string, block bigint, low array<double>, high array<double>, n int, ids binary, vectors binary"


def principal_dimensions(unit: DataFrame, dims: int, sample: int = SAMPLE) -> np.ndarray:
    """Orthonormal (length, dims) basis of the leading dimensions of a bounded sample, picked by a hash of the id."""
    rows = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = matrix(rows["embedding"])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    _, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1]))
    return np.ascontiguousarray(vectors[:, ::-1][:, :dims])


class Forest:
    """Union-find over the vectors of one pair of intervals, merged by arrays of roots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> None:
        while True:
            ra, rb = self.root[rows], self.root[cols]
            i, j = np.nonzero(linked & (ra[:, None] != rb[None, :]))
            if not len(i):
                return
            a, b = ra[i[0]], rb[j[0]]
            same = np.isin(self.root, np.concatenate([[a], [b], rb[j[i == i[0]]]]))
            self.root[same] = self.root[same].min()


def join_intervals(xa, xb, za, zb, same: bool, threshold: float, eps: float):
    """Links of two intervals: (number of links of each row of ``xa`` and ``xb``, roots of the rows stacked).

    Halves are joined recursively; two runs whose boxes in the leading dimensions lie farther apart than ``eps`` are skipped.
    Cosines within 1e-9 of the threshold are settled by their own sums.
    """
    na, nb = len(xa), len(xb)
    count_a, count_b = np.zeros(na, "i8"), np.zeros(nb, "i8")
    ua, ub = xa / np.linalg.norm(xa, axis=1)[:, None], xb / np.linalg.norm(xb, axis=1)[:, None]
    forest = Forest(na if same else na + nb)
    shift = 0 if same else na
    todo = [(0, na, 0, nb)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0 or a0 == a1 or b0 == b1:
            continue  # below the diagonal: met from the other side
        la, ha, lb, hb = za[a0:a1].min(0), za[a0:a1].max(0), zb[b0:b1].min(0), zb[b0:b1].max(0)
        gap = np.maximum(0, np.maximum(lb - ha, la - hb))
        if (gap * gap).sum() > eps * eps:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            todo += [(a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)]
            continue
        cos = ua[a0:a1] @ ub[b0:b1].T
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9)):
            p, q = xa[a0 + i], xb[b0 + j]
            cos[i, j] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q))
        linked = cos >= threshold
        if same:
            linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if linked.any():
            count_a[a0:a1] += linked.sum(1)
            count_b[b0:b1] += linked.sum(0)
            forest.link(np.arange(a0, a1), np.arange(b0, b1) + shift, linked)
    return count_a, count_b, forest.root


def near_vectors(vectors: DataFrame, threshold: float = 0.93, leading: int = LEADING, interval: int = INTERVAL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): links join vectors of equal non-null labels with cosine >= ``threshold``.

    Unit vectors are sorted by label and by the cells, ``eps`` wide, of their leading principal coordinates, and the sequence is cut
    into intervals. Interval pairs come from an equi-join on the cells that their boxes cover in two dimensions (and the next cell);
    pairs whose boxes are provably farther apart than ``eps`` are dropped. Links are counted inside the pair's task and only one row
    a vector leaves it, so a cluster of any size emits no pairs. Lengths other than the most frequent one form groups of their own.

    Unusable vectors, null labels and null ids link with nothing and keep their row; repeated ids are one vector (one null id
    row for all); an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = one_per_id(vectors, "label")
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    sizes = [r[0] for r in ok.select(F.size("embedding").alias("s")).groupBy("s").count().orderBy("s").select("s").collect()]
    # Length of the chord between unit vectors at the threshold, with room for rounding.
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    tiles = None
    for size in sizes:
        part = _tiles(ok.where(F.size("embedding") == size), size, threshold, eps, leading, interval)
        tiles = part if tiles is None else tiles.unionByName(part)
    base = rows.select("vec_id")
    if tiles is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tiles = written(tiles, "links")
    counts = tiles.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = connected_components(tiles, "vec_id", "root").withColumnRenamed("node", "vec_id")
    out = base.join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _tiles(ok: DataFrame, size: int, threshold: float, eps: float, leading: int, interval: int) -> DataFrame:
    """(vec_id, n, root) for every linked vector of every interval pair, for vectors of one length."""
    spark, leading = ok.sparkSession, min(leading, size)
    basis = principal_dimensions(ok.select("vec_id", "embedding"), leading)
    stored = "<f4" if ok.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def project(batches):
        for b in batches:
            x = matrix(b.column(2))
            z = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis if len(x) else np.zeros((0, leading))
            cells = np.floor(z / eps).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(cells), pa.list_(pa.int32())), pa.array([r.tobytes() for r in z], pa.binary()),
                 pa.array([r.astype(stored).tobytes() for r in x], pa.binary())], names=["vec_id", "label", "cells", "z", "x"])

    def cut(batches):
        task, used = TaskContext.get().partitionId() << 32, 0
        held, label = [], None

        def out():
            z = np.stack([np.frombuffer(r[1], "f8") for r in held])
            return pa.RecordBatch.from_pylist([{
                "label": label, "block": task | used, "low": z.min(0).tolist(), "high": z.max(0).tolist(), "n": len(held),
                "ids": np.array([r[0] for r in held], "<i8").tobytes(), "vectors": b"".join(r[2] for r in held)}],
                schema=pa.schema([("label", pa.string()), ("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                                  ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for b in batches:
            for vec_id, own, z, x in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (own != label or len(held) == interval):
                    yield out()
                    held, used = [], used + 1
                held.append((vec_id, z, x))
                label = own
        if held:
            yield out()

    cells = ok.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(
        project, "vec_id bigint, label string, cells array<int>, z binary, x binary")
    order = ("label", *(F.col("cells")[i] for i in range(leading)), "vec_id")
    blocks = written(cells.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "z", "x").mapInArrow(cut, _BLOCK), "intervals")

    def covered(side: str) -> DataFrame:
        box = blocks.select("label", F.col("block").alias(side), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"))
        for d in range(min(2, leading)):
            first, last = (F.floor(F.col(f"{side}_{e}")[d] / eps) for e in ("low", "high"))
            box = box.withColumn(f"{side}_{d}", first).withColumn(f"key_{d}", F.explode(F.sequence(first, last + 1)))
        return box

    keys = [f"key_{d}" for d in range(min(2, leading))]
    pairs = covered("a").join(covered("b"), ["label", *keys]).where(F.col("a") <= F.col("b"))
    for d in range(len(keys)):
        pairs = pairs.where(F.col(keys[d]) == F.greatest(f"a_{d}", f"b_{d}"))
    gaps = [F.greatest(F.lit(0.0), F.col("b_low")[d] - F.col("a_high")[d], F.col("a_low")[d] - F.col("b_high")[d]) for d in range(leading)]
    pairs = pairs.where(sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps).select("a", "b")
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("ids").alias(f"{s}_ids"), F.col("vectors").alias(f"{s}_vectors"))

    def join(batches):
        for b in batches:
            for a, c, a_ids, a_x, c_ids, c_x in zip(*(b.column(i).to_pylist() for i in range(6))):
                ids_a, ids_b = np.frombuffer(a_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                xa, xb = (np.frombuffer(x, stored).astype("f8").reshape(-1, size) for x in (a_x, c_x))
                za, zb = ((x / np.linalg.norm(x, axis=1)[:, None]) @ basis for x in (xa, xb))
                count_a, count_b, roots = join_intervals(xa, xb, za, zb, a == c, threshold, eps)
                ids, counts = (ids_a, count_a + count_b) if a == c else (np.concatenate([ids_a, ids_b]), np.concatenate([count_a, count_b]))
                smallest = np.full(len(ids), np.iinfo("i8").max)
                np.minimum.at(smallest, roots, ids)
                on = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(v[on]) for v in (ids, counts, smallest[roots])], names=["vec_id", "n", "root"])

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_ids", "a_vectors", "b_ids", "b_vectors")
            .mapInArrow(join, "vec_id bigint, n bigint, root bigint"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0
    and len(list_filter(embedding, lambda x: x<>0))>0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label=b.label and a.vec_id<>b.vec_id and len(a.e)=len(b.e)
  where list_dot_product(a.e,b.e)/sqrt(list_dot_product(a.e,a.e)*list_dot_product(b.e,b.e))>=0.93),
reach as (select vec_id as node, vec_id as other from embeddings
  union select reach.node, links.b from reach join links on reach.other=links.a)
select e.vec_id, coalesce(n, 0) as n_links, m as component_id, e.vec_id=m as kept
from embeddings e left join (select a, count(*) as n from links group by a) c on c.a=e.vec_id
join (select node, min(other) as m from reach group by node) r on r.node=e.vec_id
"""
