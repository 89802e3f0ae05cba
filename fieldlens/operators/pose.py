"""Keypoints: peak decoding, confidences, occlusion flags, shortlists and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions import grids as R
from fieldlens.schemas import KEYPOINT_NAMES


def joint_name(joint_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in KEYPOINT_NAMES])
    return F.coalesce(F.get(names, joint_id), F.concat(F.lit("keypoint_"), joint_id.cast("string")))


def decode_peaks(heatmaps: DataFrame, side: int = 256) -> DataFrame:
    """First highest cell of every heatmap, as a point in the original image.

    Input: image_id, joint_id, map_w, heatmap (flat array), width, height. Adds peak_x, peak_y, confidence, x, y.
    """
    index = F.array_position("heatmap", F.array_max("heatmap")) - 1
    cells = heatmaps.withColumns({
        "confidence": F.array_max("heatmap"), "peak_y": F.floor(index / F.col("map_w")).cast("int"),
        "peak_x": (index % F.col("map_w")).cast("int"),
    })
    lb = G.letterbox(F.col("width"), F.col("height"), side)
    step = F.lit(float(side)) / F.col("map_w")
    x, y = G.out_of_letterbox(F.col("peak_x") * step, F.col("peak_y") * step, lb, F.col("width"), F.col("height"))
    return cells.withColumns({"x": x, "y": y})


def occlusion_flags(peaks: DataFrame, side: int = 256, low: float = 0.1, margin: int = 10) -> DataFrame:
    """Flag weak peaks, peaks within one cell of the map edge, and points near or beyond the image edge."""
    c = F.col
    lb = G.letterbox(c("width"), c("height"), side)
    step = F.lit(float(side)) / c("map_w")
    x, y = (c("peak_x") * step - lb.dx) / lb.scale, (c("peak_y") * step - lb.dy) / lb.scale
    rows = F.size("heatmap") / c("map_w")
    edge = (c("peak_x") <= 1) | (c("peak_x") >= c("map_w") - 2) | (c("peak_y") <= 1) | (c("peak_y") >= rows - 2)
    rim = (x < margin) | (x > c("width") - margin) | (y < margin) | (y > c("height") - margin)
    return peaks.withColumn("occluded", (c("confidence") < low) | edge | rim)


def heatmap_statistics(a: Column) -> dict[str, Column]:
    mean = R.array_mean(a)
    var = F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / F.size(a) - mean * mean
    return {"min": F.array_min(a), "max": F.array_max(a), "mean": mean, "std": F.sqrt(F.greatest(var, F.lit(0.0))),
            "argmax": (F.array_position(a, F.array_max(a)) - 1).cast("int")}


def keypoint_statistics(points: DataFrame, threshold: float = 0.3) -> DataFrame:
    c = F.col("confidence")
    return points.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c > threshold).alias("valid"), F.avg(c).alias("avg_confidence"),
        F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def keypoint_shortlist(points: DataFrame, n: int = 4, families=("Mouth", "Eye", "Tail")) -> DataFrame:
    """The ``n`` most confident joints of an image, plus the best joint of each named family.

    Joints per image are bounded by the model (one row per joint), so the windows are small.
    """
    named = points.withColumn("joint_name", joint_name(F.col("joint_id")))
    family = F.coalesce(*[F.when(F.contains("joint_name", F.lit(f)), F.lit(f)) for f in families], F.lit(""))
    order = [F.col("confidence").desc(), F.col("joint_id")]
    ranked = named.withColumn("_family", family).withColumns({
        "_all": F.row_number().over(Window.partitionBy("image_id").orderBy(*order)),
        "_own": F.row_number().over(Window.partitionBy("image_id", "_family").orderBy(*order)),
    })
    return ranked.filter((F.col("_all") <= n) | ((F.col("_family") != "") & (F.col("_own") == 1))).drop("_family", "_all", "_own")


def keypoint_map(points: DataFrame) -> DataFrame:
    """Per image a map from joint name to its point (one entry per joint of the model)."""
    entry = F.struct(joint_name(F.col("joint_id")), F.struct("x", "y", "confidence"))
    return points.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias("keypoints"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Total, success, failed, mean and total time of successes over (status, ms) rows."""
    ok = F.col("status") == "success"
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("ms"))).alias("avg_ms"), F.coalesce(F.sum(F.when(ok, F.col("ms"))), F.lit(0.0)).alias("total_ms"))


def compare_runs(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per image the largest L1 difference over joints, and whether all joints are within the tolerance."""
    other = b.select("image_id", "joint_id", *[F.col(c).alias(f"{c}_b") for c in ("x", "y", "confidence")])
    diff = sum((F.abs(F.col(c) - F.col(f"{c}_b")) for c in ("x", "y", "confidence")), F.lit(0.0))
    return a.join(other, ["image_id", "joint_id"]).groupBy("image_id").agg(
        F.max(diff).alias("max_diff"), F.bool_and(diff <= tolerance).alias("within"), F.count(F.lit(1)).alias("n")
    )
