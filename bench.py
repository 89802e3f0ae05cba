"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldlens.plans import load_all  # noqa: E402
from fieldlens.session import local_session  # noqa: E402

HEADLINE = (
    "detection_counts", "decoded_detections", "overlapping_pairs", "best_match_per_detection", "exclusive_matches",
    "average_precision", "quality_sweep", "roi_pooling", "gradient_tiles", "mask_runs", "keypoint_peaks",
    "parts_to_annotations", "timing_summary", "run_sessions", "sliding_throughput", "stem_collisions", "shuffled_halves",
    "pair_order_correlation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, "fieldlens-bench")
    registry = load_all()
    registry["display_classes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "median": round(statistics.median(seconds.values()), 3), "queries": seconds, "sf": float(sf.group(1)) if sf else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
