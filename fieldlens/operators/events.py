"""Processing events in batch form: status, throughput, sessions, tool usage, provenance rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.running import running_sums


def latest_status(events: DataFrame, key: str = "path", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Last event per key; repeated events change nothing. An aggregate with map-side combine, no sort."""
    return events.groupBy(key).agg(F.max_by("kind", F.struct(ts, tie)).alias("status"), F.max(ts).alias("last_ts"))


def throughput(events: DataFrame, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Per time window: images ok and failed, milliseconds per success. Works on batches and (watermarked) streams."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    ok = F.col("kind") != "error"
    return events.groupBy(window.alias("w")).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.avg(F.when(ok, F.col("ms"))).alias("ms_per_ok")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_ok", "n_failed", "ms_per_ok")


def run_sessions(events: DataFrame, gap_seconds: int, key: str = "run_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Bursts of events per run separated by more than the gap, with first and last event and count.

    The previous event time is a running maximum over day slices, so one very busy run is spread over many tasks.
    """
    day = F.date_trunc("day", F.col(ts))
    order = [F.col(ts), F.col(tie)]
    marked = running_sums(events.select(key, ts, tie), [key], [day], order, {"_no": F.lit(1).cast("bigint")})
    prev = marked.select(key, (F.col("_no") + 1).alias("_no"), F.col(ts).alias("_prev"))
    starts = marked.join(prev, [key, "_no"], "left").withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col(ts) >= F.col("_prev") + F.make_interval(secs=F.lit(gap_seconds))), 1).otherwise(0).cast("bigint"))
    numbered = running_sums(starts, [key], [day], order, {"session_no": F.col("_new")})
    return numbered.groupBy(key, "session_no").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def tool_usage(runs: DataFrame, tools: Column) -> DataFrame:
    """Invocations and total time per tool; ``tools`` is an array, so a run of two tools counts for both."""
    return runs.select("*", F.explode(tools).alias("tool")).groupBy("tool").agg(
        F.count(F.lit(1)).alias("invocations"), F.sum("ms").alias("total_ms"))


def slowest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.col("ms").desc(), "event_id").limit(n)


def provenance_rollup(detections: DataFrame) -> DataFrame:
    """Detections and mean confidence by source type and class with all totals."""
    return detections.cube("source_type", "class_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.grouping_id().cast("int").alias("level"))


