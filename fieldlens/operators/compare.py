"""Comparing model variants and summarising timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.matching import best_matches
from fieldlens.operators.running import medians

DIFFERENCES = ("max_absolute_diff", "mean_absolute_diff", "rmse", "relative_error", "cosine_similarity")


def pair_outputs(base: DataFrame, other: DataFrame) -> DataFrame:
    """The flat output tensors (``values``) of two models side by side, one row per image; a missing one is NULL."""
    return base.select("image_id", F.col("values").alias("base")).join(
        other.select("image_id", F.col("values").alias("other")), "image_id", "full_outer")


def output_differences(pairs: DataFrame) -> DataFrame:
    """Difference metrics per image over paired elements; ``same_shape`` is false when an element has no partner.

    Tensors stay arrays, so the join moves one row per image and the metrics need no grouping.
    """
    none = F.array().cast("array<double>")
    elements = F.zip_with(F.coalesce("base", none), F.coalesce("other", none), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zipped = pairs.select("image_id", elements.alias("_e"), (F.col("base").isNotNull() & F.col("other").isNotNull()).alias("_both"))
    paired = lambda e: e["a"].isNotNull() & e["b"].isNotNull()
    gap = lambda e: F.abs(e["a"] - e["b"])
    total = lambda f: F.aggregate("_e", F.lit(0.0), lambda s, e: s + F.coalesce(f(e), F.lit(0.0)))
    mean = lambda f: F.try_divide(total(f), F.size(F.filter("_e", paired)))
    norm = lambda side: F.sqrt(total(lambda e: e[side] * e[side]))
    return zipped.select(
        "image_id", F.array_max(F.transform("_e", gap)).alias("max_absolute_diff"), mean(gap).alias("mean_absolute_diff"),
        F.sqrt(mean(lambda e: (e["a"] - e["b"]) * (e["a"] - e["b"]))).alias("rmse"),
        F.array_max(F.transform("_e", lambda e: gap(e) / (F.abs(e["a"]) + 1e-8))).alias("relative_error"),
        (total(lambda e: e["a"] * e["b"]) / (norm("a") * norm("b") + 1e-8)).alias("cosine_similarity"),
        (F.col("_both") & F.forall("_e", paired)).alias("same_shape"),
    )


def difference_rollup(per_image: DataFrame, metrics: Sequence[str] = DIFFERENCES, by: Sequence[str] = ()) -> DataFrame:
    """Average and maximum of every metric over the images, as (metric, avg, max) rows for each value of ``by``."""
    long = per_image.unpivot([*by, "image_id"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))


def within_tolerance(per_image: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return per_image.agg((F.max("max_absolute_diff") <= tolerance).alias("passed"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Runs, mean, median, min, max and sample deviation (0 for one run) per series."""
    stats = timings.groupBy("series").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("mean"), F.min("ms").alias("min"), F.max("ms").alias("max"),
        F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("stdev"))
    return stats.join(medians(timings, ["series"], "ms"), "series")


def warm_timing_summary(timings: DataFrame) -> DataFrame:
    """Mean, population deviation, min and max per series without the warm-up run 0."""
    return timings.filter(F.col("run_no") > 0).groupBy("series").agg(
        F.avg("ms").alias("mean_ms"), F.stddev_pop("ms").alias("std_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def size_report(models: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Megabytes, percent saved and ratio against the first model (lowest ``model_no``) of each group."""
    first = models.groupBy(*group).agg(F.min_by("bytes", "model_no").alias("_base"))
    joined = models.join(first, list(group)) if group else models.withColumn("_base", first.scalar())
    size = F.col("bytes") / 1048576
    return joined.select(
        *models.columns, size.alias("size_mb"), F.coalesce(F.try_divide((F.col("_base") - F.col("bytes")) * 100.0, F.col("_base")), F.lit(0.0)).alias("reduction_percent"),
        F.try_divide(F.col("_base"), F.col("bytes")).alias("compression_ratio"))


def performance_table(sizes: DataFrame, timings: DataFrame, rollups: DataFrame) -> DataFrame:
    """One row per model: size, mean time, average cosine and RMSE, largest difference, percent saved."""
    pick = lambda metric, field, out: F.max(F.when(F.col("metric") == metric, F.col(field))).alias(out)
    diffs = rollups.groupBy("model").agg(
        pick("cosine_similarity", "avg_value", "cosine"), pick("rmse", "avg_value", "rmse"), pick("max_absolute_diff", "max_value", "max_diff"))
    joined = sizes.join(timings, "model", "left").join(diffs, "model", "left")
    zero = F.lit(0.0)
    return joined.select(
        "model", "size_mb", F.coalesce("mean_ms", zero).alias("mean_ms"), F.coalesce("std_ms", zero).alias("std_ms"),
        F.coalesce("cosine", F.lit(1.0)).alias("cosine"), F.coalesce("rmse", zero).alias("rmse"), F.coalesce("max_diff", zero).alias("max_diff"), "reduction_percent")


def average_iou(base: DataFrame, other: DataFrame, crowds: DataFrame | None = None) -> DataFrame:
    """Mean best IoU per image between the boxes of two runs (0 for unmatched boxes); ``crowds`` as for ``best_matches``."""
    boxes = base.select("image_id", "det_id", "x1", "y1", "x2", "y2")
    return best_matches(boxes, other, ["image_id"], "det_id", "det_id", crowds=crowds).groupBy("image_id").agg(
        F.avg("iou").alias("mean_iou"), F.count_if(F.col("match_id").isNull()).alias("unmatched"))
