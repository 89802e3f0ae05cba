"""Shared handling of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: str) -> Column:
    """True for vectors that are not null, not empty, not zero and hold finite components only."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def one_per_id(df: DataFrame, *extra: str) -> DataFrame:
    """One row for each vec_id; of differing rows with one id the largest (by ``extra``, then vector) stands for it."""
    top = df.select(F.col("vec_id").cast("long"), F.struct(*extra, "embedding").alias("s")).groupBy("vec_id").agg(F.max("s").alias("s"))
    return top.select("vec_id", *(f"s.{c}" for c in (*extra, "embedding")))
