"""Running user-supplied models over image tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T


def detector_udf(make_predict: Callable, input_shape: list[int], batch_size: int = 64):
    """A model as a function of an array column; ``input_shape`` is the shape of one input.

    ``make_predict()`` runs once per Python worker and returns ``predict(batch) -> {boxes, logits, orient}`` with
    arrays of shape (batch, queries * 4), (batch, queries * classes) and (batch, queries * 2).
    A small ``batch_size`` keeps pixel batches inside the worker's memory.
    """
    floats = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(n, floats) for n in ("boxes", "logits", "orient")])
    return predict_batch_udf(make_predict, return_type=schema, batch_size=batch_size, input_tensor_shapes=[input_shape])


def raw_outputs(images: DataFrame, prediction: Column, queries: int, classes: int) -> DataFrame:
    """Flat model outputs per image to (image_id, query_id, box, logits, orient) rows."""
    p = images.select("image_id", prediction.alias("p"))
    cut = lambda field, q, n: F.slice(F.col(f"p.{field}"), q * n + 1, F.lit(n))
    rows = F.transform(F.sequence(F.lit(0), F.lit(queries - 1)), lambda q: F.struct(
        q.alias("query_id"), cut("boxes", q, 4).alias("box"), cut("logits", q, classes).alias("logits"), cut("orient", q, 2).alias("orient")))
    return p.select("image_id", F.inline(rows))


def apply_capturing_errors(df: DataFrame, column: str, fn: Callable, return_type: T.DataType) -> DataFrame:
    """Add ``value`` and ``error``: a failing row keeps its place with the error text, the others go on."""
    out = T.StructType([T.StructField("value", return_type), T.StructField("error", T.StringType())])

    @F.pandas_udf(out)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((fn(v), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return df.withColumn("_r", run(column)).select(*df.columns, "_r.value", "_r.error")


def require_success(results: DataFrame) -> DataFrame:
    """Strict mode: the rows, failing the job at the first one that carries an error."""
    return results.filter(F.assert_true(F.col("error").isNull(), F.concat(F.lit("failed: "), F.col("error"))).isNull())


def failure_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@F.udtf(returnType=T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.DoubleType())]))
class GridCells:
    """Table function: a flat grid and its width to (y, x, v) rows, for SQL users."""

    def eval(self, cells: list, width: int) -> Iterator[tuple]:
        for i, v in enumerate(cells):
            yield i // width, i % width, float(v)


def register_functions(spark) -> None:
    """Make the table function available to SQL as ``grid_cells_of(cells, width)``."""
    spark.udtf.register("grid_cells_of", GridCells)


def observed(df: DataFrame, name: str, **metrics: Column):
    """Attach named metrics that are reported when the job ends; returns (table, observation)."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, *[c.alias(k) for k, c in metrics.items()]), obs


def linear_detector(queries: int, classes: int, n_pixels: int, seed: int = 0) -> Callable:
    """A stand-in model for tests and examples: the weight of pixel i for output j is ((7 i + 13 j + seed) mod 101 - 50) / 25."""

    def make_predict():
        weights = lambda n: ((7 * np.arange(n_pixels)[:, None] + 13 * np.arange(queries * n)[None, :] + seed) % 101 - 50) / 25
        w = {k: weights(n) for k, n in (("boxes", 4), ("logits", classes), ("orient", 2))}

        def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
            x = batch.reshape(len(batch), -1).astype(float)
            return {"boxes": 1 / (1 + np.exp(-(x @ w["boxes"]))), "logits": x @ w["logits"], "orient": x @ w["orient"]}

        return predict

    return make_predict
