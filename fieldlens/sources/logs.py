"""Metric logs, evaluation results, batch reports and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from fieldlens.schemas import BENCHMARK_ENTRY, METRIC_LOG

_METRICS = ("map@50:95", "map@50", "precision", "recall")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return metric_rows(spark.read.schema(METRIC_LOG).json(path))


def parse_metric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """As ``read_metric_log`` for lines that already are a column (a stream, or text files)."""
    return lines.withColumn("_doc", F.from_json(column, METRIC_LOG)).select(
        *[c for c in lines.columns if c != column], "_doc.*")


def metric_rows(log: DataFrame) -> DataFrame:
    """Nested class maps of regular and averaged weights to (epoch, series, class, metric, value) rows."""
    keys = [c for c in log.columns if c not in ("test_results_json", "ema_test_results_json")]
    entry = lambda name, doc: F.transform(
        F.col(f"{doc}.class_map"), lambda c: F.struct(F.lit(name).alias("series"), c.alias("c")))
    both = F.concat(*[F.coalesce(entry(n, d), F.array().cast(_ENTRY)) for n, d in (("regular", "test_results_json"), ("ema", "ema_test_results_json"))])
    flat = log.select(*keys, F.inline(both)).select(*keys, "series", F.col("c.class").alias("class"), *[F.col(f"c.`{m}`").alias(m) for m in _METRICS])
    return flat.unpivot([*keys, "series", "class"], list(_METRICS), "metric", "value").filter(F.col("value").isNotNull())


_ENTRY = T.ArrayType(T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("c", METRIC_LOG["test_results_json"].dataType["class_map"].dataType.elementType),
]))


def results_document(report: DataFrame, split: str = "split") -> DataFrame:
    """One JSON document: class_map keyed by split. The input is a class report, a few rows per split."""
    entry = F.struct("class", *[F.col(m) for m in report.columns if m not in ("class", split)])
    per_split = report.groupBy(split).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    return per_split.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(split, "rows"))).alias("class_map"))).alias("document"))


def write_batch_report(results: DataFrame, summary: DataFrame, configuration: Column, folder: str) -> None:
    """Per-image results as a JSON dataset; configuration and summary as one row beside it."""
    results.write.mode("overwrite").json(f"{folder}/results")
    summary.select(configuration.alias("configuration"), F.struct(*summary.columns).alias("summary")).write.mode("overwrite").json(f"{folder}/summary")


def read_benchmark_stats(spark: SparkSession, path: str) -> DataFrame:
    """Name -> statistics documents as (name, runs, phase, mean, median, min, max, stdev) rows."""
    doc = spark.read.text(path, wholetext=True)
    entries = doc.select(F.explode(F.from_json("value", T.MapType(T.StringType(), BENCHMARK_ENTRY))).alias("name", "s"))
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"s.{p}").alias("t")) for p in ("load_time", "inference_time", "total_time")])
    return entries.select("name", "s.runs", F.inline(phases)).select("name", "runs", "phase", "t.*").filter(F.col("mean").isNotNull())
