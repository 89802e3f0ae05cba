"""Image-analysis tables on Spark: decode, match, score, evaluate and prepare detections at corpus scale."""
