"""Output differences of tensors of unlike length, and the metric filters."""

import math

from pyspark.sql import functions as F

from fieldlens.operators import compare as M
from fieldlens.operators import selection as S


def test_differences_of_unlike_tensors(spark):
    kind = "image_id long, values array<double>"
    base = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 2.0]), (3, [5.0])], kind)
    other = spark.createDataFrame([(1, [3.0, 2.0]), (2, [1.0]), (4, [])], kind)
    rows = {r.image_id: r for r in M.output_differences(M.pair_outputs(base, other)).collect()}
    assert rows[1].max_absolute_diff == 2.0 and rows[1].mean_absolute_diff == 1.0 and rows[1].same_shape
    assert math.isclose(rows[1].rmse, math.sqrt(2)) and math.isclose(rows[1].cosine_similarity, 17 / (5 * math.sqrt(13)), rel_tol=1e-8)
    assert rows[2].max_absolute_diff == 0.0 and not rows[2].same_shape  # the element without a partner counts for the shape only
    assert rows[3].max_absolute_diff is None and not rows[3].same_shape
    assert rows[4].mean_absolute_diff is None and not rows[4].same_shape


def test_rollup_by_model(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "image_id long, model string, rmse double")
    got = {(r.model, r.metric): (r.avg_value, r.max_value) for r in M.difference_rollup(rows, ["rmse"], by=["model"]).collect()}
    assert got == {("a", "rmse"): (2.0, 3.0), ("b", "rmse"): (5.0, 5.0)}


def test_finite_and_non_finite_split_the_rows(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (None,)], "v double")
    assert S.non_finite(d, "v").count() == 3
    assert {r.v for r in S.finite(d, "v").collect()} == {1.0, None}


def test_seeded_unit_is_even_and_repeatable(spark):
    d = spark.range(20000).select(S.seeded_unit(F.col("id"), 3, "x").alias("u"))
    low, high, mean = d.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01
    assert d.exceptAll(spark.range(20000).select(S.seeded_unit(F.col("id"), 3, "x").alias("u"))).count() == 0
