"""Detections out of raw model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.operators.selection import known_classes, top_k


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def class_scores(raw: DataFrame) -> DataFrame:
    """(image_id, query_id, box, logits, orient) rows exploded to one row per (query, class) with its probability."""
    return raw.select("image_id", "query_id", "box", "orient", F.posexplode("logits").alias("class_id", "_logit")).withColumn(
        "confidence", sigmoid(F.col("_logit"))
    ).drop("_logit")


def decode_detections(
    raw: DataFrame, images: DataFrame, k: int = 10, threshold: float = 0.5, model_size: int | None = None, clamp: bool = False
) -> DataFrame:
    """Per image the ``k`` best (query, class) pairs at or above ``threshold``, with pixel boxes, angles and names.

    Dropping low scores before the top-k gives the same rows as dropping them after it, and shuffles less.
    Ties go to the lower (query, class). Only surviving rows are turned into boxes.
    """
    scored = class_scores(raw).filter(F.col("confidence") >= threshold)
    kept = top_k(scored, ["image_id"], [F.col("confidence").desc(), F.col("query_id"), F.col("class_id")], k, rank="det_id")
    named = known_classes(kept, model_size)
    sized = named.join(images.select("image_id", "width", "height"), "image_id")
    at = lambda i: F.get("box", F.lit(i))
    b = G.scaled(G.corners_from_center(at(0), at(1), at(2), at(3), clamp), F.col("width"), F.col("height"))
    return sized.select(
        "image_id", "det_id", F.col("class_id").cast("int").alias("class_id"), "class_name", *b.named(), "confidence",
        G.angle_of(F.get("orient", F.lit(0)), F.get("orient", F.lit(1))).alias("angle"),
    )


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("image_id", "class_name").agg(F.count(F.lit(1)).alias("n"))


def class_counts_wide(detections: DataFrame, classes) -> DataFrame:
    """One column per class, zero when absent. Listed classes need no pass to discover them."""
    return detections.groupBy("image_id").agg(*[F.count_if(F.col("class_name") == c).alias(f"n_{c}") for c in classes])


def best_per_class(detections: DataFrame) -> DataFrame:
    return top_k(detections, ["image_id", "class_id"], [F.col("confidence").desc(), F.col("det_id")], 1)
