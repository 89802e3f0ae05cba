"""Streaming jobs run over files with availableNow, compared with their batch form."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import events as V
from fieldlens.sources.catalog import stream_image_catalog
from fieldlens.streaming import jobs as J


@pytest.fixture(scope="module")
def event_stream(spark, tables, tmp_path_factory):
    """The events as several files in time order, read as a stream two files at a time."""
    folder = str(tmp_path_factory.mktemp("events"))
    ev = tables.run_events.withColumn("ts", F.col("ts").cast("timestamp"))
    ordered = ev.orderBy("ts").toPandas()
    for i in range(4):
        part = ordered.iloc[i * len(ordered) // 4:(i + 1) * len(ordered) // 4]
        spark.createDataFrame(part, ev.schema).coalesce(1).write.mode("append").parquet(f"{folder}/")
    return ev, lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def test_catalog_stream(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for n in ("a.jpg", "b.txt", "c.png"):
        (d / n).write_bytes(b"x")
    out = J.run_to_memory(stream_image_catalog(spark, str(d)), "t_catalog", "append", str(tmp_path / "cp"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in out.collect()) == ["a.jpg", "c.png"]


def test_status(spark, event_stream, tmp_path):
    ev, stream = event_stream
    out = J.run_to_memory(J.image_status(stream()), "t_status", "update", str(tmp_path / "cp")).toPandas()
    last = out.sort_values("event_id").groupby("path").last()
    want = V.latest_status(ev).toPandas().set_index("path")
    assert (last.status.sort_index() == want.status.sort_index()).all()


def test_throughput(spark, event_stream, tmp_path):
    ev, stream = event_stream
    out = J.run_to_memory(J.live_throughput(stream(), "1 day"), "t_rate", "append", str(tmp_path / "cp"))
    want = {tuple(r) for r in V.throughput(ev, "1 day").select("window_start", "n_ok", "n_failed").collect()}
    got = {tuple(r) for r in out.select("window_start", "n_ok", "n_failed").collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last windows stay open


def test_sessions(spark, event_stream, tmp_path):
    ev, stream = event_stream
    out = J.run_to_memory(J.live_sessions(stream(), "2 hours"), "t_sessions", "append", str(tmp_path / "cp"))
    want = {(r.run_id, r.first_ts, r.n_events) for r in V.run_sessions(ev, 7200).collect()}
    got = {(r.run_id, r.first_ts, r.n_events) for r in out.collect()}
    assert len(got) > 50 and got <= want


def test_dedupe(spark, event_stream, tmp_path):
    ev, stream = event_stream
    out = J.run_to_memory(J.deduplicated(stream(), watermark="60 days"), "t_dedupe", "append", str(tmp_path / "cp"))
    assert out.count() == ev.select("path").distinct().count() == out.select("path").distinct().count()


def test_static_join(spark, event_stream, tmp_path):
    ev, stream = event_stream
    quality = spark.range(5).select(F.col("id").alias("image_id"), (F.col("id") * 1.5).alias("quality"))
    dets = stream().select((F.col("event_id") % 10).alias("image_id"), "event_id")
    out = J.run_to_memory(J.with_static_quality(dets, quality), "t_static", "append", str(tmp_path / "cp"))
    assert out.count() == ev.count() and out.filter("quality is null").count() == ev.filter("event_id % 10 >= 5").count()


def test_stage_join(spark, event_stream, tmp_path):
    ev, stream = event_stream
    q = lambda d: d.filter("kind = 'view'").select(F.col("run_id").alias("image_id"), "ts", F.col("ms").alias("quality"))
    d = lambda d: d.filter("kind = 'click'").select(F.col("run_id").alias("image_id"), "ts", "event_id")
    out = J.run_to_memory(J.stage_join(q(stream()), d(stream()), 5 * 3600, "2 days"), "t_stage", "append", str(tmp_path / "cp"))
    a, b = q(ev).toPandas(), d(ev).toPandas()
    m = a.merge(b, on="image_id", suffixes=("_q", ""))
    want = ((m.ts - m.ts_q).abs() <= pd.Timedelta(hours=5)).sum()
    assert out.count() == want > 0


_METRICS = "run_id string, epoch int, value double, ts timestamp"


def test_metric_monitor(spark, tmp_path):
    folder = str(tmp_path / "m")
    values = [0.5, 0.6, 0.59, 0.6005, 0.4, 0.7]
    at = dt.datetime(2024, 1, 1)
    for i in range(2):
        rows = [("r", e, values[e], at) for e in range(i * 3, i * 3 + 3)] + ([("r", 0, 0.99, at)] if i else [])  # a late epoch
        spark.createDataFrame(rows, _METRICS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(_METRICS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = J.run_to_memory(J.metric_monitor(stream, patience=3, width=2), "t_monitor", "append", str(tmp_path / "cp")).orderBy("epoch").collect()
    assert [r.event for r in out] == ["improve", "improve", "wait", "wait", "stop", "improve"]
    assert [r.waited for r in out] == [0, 0, 1, 2, 3, 0] and abs(out[3].avg20 - (0.59 + 0.6005) / 2) < 1e-12


def test_metric_monitor_forgets_idle_runs(spark, tmp_path):
    """State of a run that was silent for too long is gone: the epoch it had reached no longer holds back lower ones."""
    folder, cp = str(tmp_path / "m"), str(tmp_path / "cp")
    seen = []
    for run, day in (("r", 1), ("r", 2), ("other", 25), ("r", 25)):
        spark.createDataFrame([(run, 1, 0.5, dt.datetime(2024, 1, day))], _METRICS).coalesce(1).write.mode("append").parquet(folder)
        out = J.metric_monitor(spark.readStream.schema(_METRICS).parquet(folder))
        q = out.writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend((r.run_id, r.event) for r in b.collect())).option(
            "checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert seen == [("r", "improve"), ("other", "improve"), ("r", "improve")]


def test_upsert_sink(spark, tmp_path):
    sink = J.MetadataUpsert(str(tmp_path / "meta"))
    schema = "image_id int, ts timestamp, detect string, quality string"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    sink(spark.createDataFrame([(1, at(1), "d1", None), (1, at(2), None, "q1"), (2, at(1), "x", None)], schema), 0)
    second = spark.createDataFrame([(1, at(3), "d2", None), (3, at(3), None, "q3")], schema)
    sink(second, 1)
    sink(second, 1)  # replay
    want = {(1, "d2", "q1"), (2, "x", None), (3, None, "q3")}
    show = lambda: {(r.image_id, r.detect, r.quality) for r in sink.read(spark).collect()}
    assert show() == want
    sink.compact(spark)
    assert show() == want
    sink(spark.createDataFrame([(2, at(9), None, "q9")], schema), 2)
    assert show() == {(1, "d2", "q1"), (2, "x", "q9"), (3, None, "q3")}
    sink(spark.createDataFrame([(2, at(5), "x5", "late")], schema), 3)  # older than what is known of q, newer than d
    assert show() == {(1, "d2", "q1"), (2, "x5", "q9"), (3, None, "q3")}
    sink.compact(spark)
    assert show() == {(1, "d2", "q1"), (2, "x5", "q9"), (3, None, "q3")}


def test_readers_see_whole_versions(spark, tmp_path):
    """A reader that began before a replay, a compaction or a failed write keeps its version; two writers of one number both count."""
    from fieldlens.streaming.snapshots import Snapshots

    sink = J.MetadataUpsert(f"file://{tmp_path}/meta")
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = lambda *r: spark.createDataFrame(list(r), "image_id int, ts timestamp, detect string")
    show = lambda df: sorted((r.image_id, r.detect) for r in df.collect())
    sink(rows((1, at(1), "a")), 0)
    before = sink.read(spark)
    sink(rows((1, at(2), "b"), (2, at(2), "x")), 1)
    assert show(before) == [(1, "a")] and show(sink.read(spark)) == [(1, "b"), (2, "x")]
    middle = sink.read(spark)
    sink.compact(spark)
    sink(rows((1, at(2), "b"), (2, at(2), "x")), 1)  # replay of a batch that the base holds
    sink.compact(spark)
    assert show(middle) == show(sink.read(spark)) == [(1, "b"), (2, "x")]
    table = Snapshots(f"{tmp_path}/other")

    def second(entries):
        if not entries:  # another writer commits between reading and renaming
            table.commit(spark, lambda e: [*e, {"path": "data/first"}])
        return [*entries, {"path": "data/second"}]

    assert table.commit(spark, second) == 2 and [e["path"] for e in table.latest(spark)[1]] == ["data/first", "data/second"]
    sink.table.vacuum(spark, keep=1)
    assert show(sink.read(spark)) == [(1, "b"), (2, "x")] and len(list((tmp_path / "meta/data").iterdir())) == 1


def test_progress_listener(spark, event_stream, tmp_path):
    _, stream = event_stream
    ended = []
    log = J.ProgressLog(on_end=ended.append)
    spark.streams.addListener(log)
    try:
        J.run_to_memory(stream().select("path"), "t_listen", "append", str(tmp_path / "cp"))
        spark.range(1).count()
    finally:
        import time

        for _ in range(50):
            if log.batches and ended:
                break
            time.sleep(0.1)
        spark.streams.removeListener(log)
    assert log.batches and ended
