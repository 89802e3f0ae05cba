"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed in double, heaps merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.vectors import matrix, one_per_id, usable

QUERY_ROWS = 1024
CANDIDATE_ROWS = 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale of each row, norm of what they stand for, norm of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype("i1"), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile_top(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query, candidate, inner product) of each query in one tile, exactly.

    The int8 product differs from the true one by at most |q-q'||c| + |q'||c-c'|; a candidate survives unless its upper bound lies below
    the k-th largest lower bound. Products are added component by component, in order.
    """
    qi, qs, qn, qe = quantise(q)
    ci, cs, _, ce = quantise(c)
    exact = "f4" if q.shape[1] <= 1000 else "f8"  # sums of int8 products up to 2**24 are whole in float32
    near = (qi.astype(exact) @ ci.astype(exact).T).astype("f8") * qs[:, None] * cs[None, :]
    err = (qe[:, None] * np.linalg.norm(c, axis=1)[None, :] + qn[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * np.abs(near)
    low, own = near - err, q_ids[:, None] == c_ids[None, :]
    low[own] = -np.inf
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        rows, cols = np.nonzero((near + err >= floor[:, None]) & ~own)
    else:
        rows, cols = np.nonzero(~own)
    score = np.zeros(len(rows))
    for d in range(q.shape[1]):
        score += q[rows, d] * c[cols, d]
    cuts = np.searchsorted(rows, np.arange(len(q_ids) + 1))
    out = []
    for r in range(len(q_ids)):
        at = slice(cuts[r], cuts[r + 1])
        out += [(r, v, -s) for s, v in heapq.nsmallest(k, zip((-score[at]).tolist(), c_ids[cols[at]].tolist()))]
    r, v, s = (np.array([o[i] for o in out], kind) for i, kind in enumerate(("i8", "i8", "f8")))
    return q_ids[r], v, s


def nearest(vectors: DataFrame, is_query, k: int = 20, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` candidates of largest inner product for each row where ``is_query`` holds.

    Every query block meets every candidate block in one task, with ``k`` rows a query leaving it; recall is 1. Only vectors of equal
    length are compared. Ties go to the smaller vec_id. Unusable vectors (see ``usable``) and null ids take no part; repeated ids are one
    vector; an empty table gives no rows; other columns are not read.
    """
    clean = one_per_id(vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))).withColumn("size", F.size("embedding"))
    counts = clean.groupBy().agg(F.count("*").alias("c"), F.count(F.when(is_query, 1)).alias("q")).first()
    nc, nq = max(1, math.ceil(counts.c / candidate_rows)), max(1, math.ceil(counts.q / query_rows))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = clean.withColumn("cb", block(nc)).withColumn("qb", every(nq))
    queries = clean.where(is_query).withColumn("qb", block(nq)).withColumn("cb", every(nc))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = ([], [], [])
        if left.num_rows and right.num_rows:
            cols = tile_top(left["vec_id"].to_numpy(), matrix(left["embedding"]), right["vec_id"].to_numpy(), matrix(right["embedding"]), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ("size", "qb", "cb")
    found = queries.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(tile, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


SQL = """
with v as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0
             and len(list_filter(embedding, lambda x: x<>0))>0),
pairs as (select q.vec_id as query_id, c.vec_id,
            list_reduce([q.e[i]*c.e[i] for i in range(1, len(q.e)+1)], lambda x, y: x+y) as score
          from v q join v c on q.vec_id<>c.vec_id and len(q.e)=len(c.e) where q.vec_id%20=0)
select query_id, cast(row_number() over w as int) as rank, vec_id, score from pairs
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20
"""
