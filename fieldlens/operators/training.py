"""Metric logs: running bests, smoothing, early stopping, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.running import row_numbers, running_max, running_sums, trailing_windows
from fieldlens.operators.scan import improving_rows


def _epochs(epoch: str) -> list[Column]:
    return [F.floor(F.col(epoch) / 1024)]


def with_series(regular: DataFrame, ema: DataFrame) -> DataFrame:
    """Regular and averaged-weight metrics in one long table."""
    return regular.withColumn("series", F.lit("regular")).unionByName(ema.withColumn("series", F.lit("ema")))


def running_best(log: DataFrame, group: Sequence[str], epoch: str = "epoch", value: str = "value", out: str = "best") -> DataFrame:
    return running_max(log, group, _epochs(epoch), [F.col(epoch)], {out: F.col(value)})


def best_epoch(log: DataFrame, group: Sequence[str] = (), epoch: str = "epoch", value: str = "value") -> DataFrame:
    """Best value and the earliest epoch that reached it."""
    best = log.groupBy(*group).agg(F.max(F.struct(value, (-F.col(epoch)).alias("_neg"))).alias("_b"))
    return best.select(*group, F.col(f"_b.{value}").alias("best"), (-F.col("_b._neg")).alias("epoch"))


def smoothed(log: DataFrame, group: Sequence[str], order: str, value: str, width: int = 20) -> DataFrame:
    """Trailing mean, lower median and maximum over ``width`` rows, and the running average of the whole series."""
    sums = running_sums(log, group, _epochs(order), [F.col(order)], {"_total": F.col(value), "_count": F.lit(1).cast("bigint")})
    spread, w = trailing_windows(sums, group, _epochs(order), [F.col(order)], width)
    last = F.sort_array(F.collect_list(value).over(w))
    out = spread.withColumns({
        "avg": F.avg(value).over(w), "max": F.max(value).over(w),
        "median": F.get(last, F.floor((F.size(last) - 1) / 2).cast("int")), "global_avg": F.col("_total") / F.col("_count"),
    })
    return out.filter(~F.col("_halo")).select(*log.columns, "avg", "median", "max", "global_avg")


def tracked_metric(regular: str = "regular", ema: str = "ema", use_ema: bool = False) -> Column:
    """The metric early stopping looks at: the averaged weights' one, or the better of the two."""
    best = F.greatest(regular, ema)  # ignores NULLs
    return F.coalesce(F.col(ema), F.col(regular)) if use_ema else best


def early_stop_trace(
    log: DataFrame, group: Sequence[str], epoch: str = "epoch", value: str = "value", patience: int = 10, min_delta: float = 0.001
) -> DataFrame:
    """Per epoch the best value so far, epochs since the last improvement, and whether patience ran out.

    An improvement must beat the best by more than ``min_delta``; the best starts at 0; NULL and NaN never improve. The improvements come from
    a parallel scan (``scan.improving_rows``), so a run that holds most of the log is spread over its slices.
    """
    group = list(group)
    better = improving_rows(log, group, epoch, value, min_delta)
    marked = row_numbers(log, group, _epochs(epoch), [F.col(epoch)], "_no").join(better, [*group, "_no"], "left")
    traced = running_max(marked, group, _epochs(epoch), [F.col(epoch)], {
        "best": F.col("_best"), "_last": F.when(F.col("_best").isNotNull(), F.col("_no"))})
    waited = F.col("_no") - F.coalesce("_last", F.lit(0))
    return traced.select(*log.columns, F.coalesce("best", F.lit(0.0)).alias("best"), waited.alias("waited"), (waited >= patience).alias("stop"))


def stop_epoch(trace: DataFrame, group: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """First epoch at which patience ran out, NULL when it never did."""
    return trace.groupBy(*group).agg(F.min(F.when(F.col("stop"), F.col(epoch))).alias("stop_epoch"))


def training_report(log: DataFrame, group: Sequence[str]) -> DataFrame:
    """Best value, its epoch and the number of logged epochs per group."""
    n = log.groupBy(*group).agg(F.count(F.lit(1)).alias("n_epochs"))
    return best_epoch(log, group).join(n, list(group))
