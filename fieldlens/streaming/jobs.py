"""Structured Streaming forms of the event and metadata jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlens.operators.events import throughput
from fieldlens.streaming.snapshots import Entries, Snapshots

STATUS_OUT = "path string, status string, event_id bigint"
STATUS_STATE = "kind string, ts_us bigint, event_id bigint"
MONITOR_OUT = "run_id string, epoch int, value double, best double, waited int, avg20 double, event string"
MONITOR_STATE = "best double, waited int, recent string, epoch int"


def image_status(events: DataFrame, watermark: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Latest status per path as updates; an event older than the one kept, or a repeat, changes nothing.

    State is one small row per path and goes away once the watermark is ``idle_ms`` past its last event; events later
    than the watermark are dropped. The events of a path stream through in Arrow batches; only the newest is held.
    """

    def keep_newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        best = old
        for batch in batches:
            stamps = batch.ts.astype("datetime64[us]").astype("int64")
            for kind, us, event_id in zip(batch.kind, stamps, batch.event_id):
                if best is None or (us, event_id) > (best[1], best[2]):
                    best = (kind, int(us), int(event_id))
        if best is None:
            return
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        if best != old:
            yield pd.DataFrame({"path": [key[0]], "status": [best[0]], "event_id": [best[2]]})

    return events.withWatermark("ts", watermark).groupBy("path").applyInPandasWithState(
        keep_newest, STATUS_OUT, STATUS_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def live_throughput(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Windowed counts; rows later than the watermark are dropped and closed windows are emitted once."""
    return throughput(events.withWatermark("ts", watermark), size, slide)


def live_sessions(events: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Session windows per run. Sessions are merged inside each task before the shuffle (see ``configure``)."""
    s = events.withWatermark("ts", watermark).groupBy("run_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n_events")).select("run_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n_events")


def configure(spark: SparkSession) -> None:
    """Settings the streams rely on at scale: disk-backed state and session merging before the shuffle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def deduplicated(events: DataFrame, key: str = "path", watermark: str = "1 hour") -> DataFrame:
    """First event per key; repeats within the watermark are dropped."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def with_static_quality(detections: DataFrame, quality: DataFrame) -> DataFrame:
    """Stream of detections joined to a static quality table; images without a map keep their row."""
    return detections.join(quality, "image_id", "left")


def stage_join(quality: DataFrame, detections: DataFrame, bound_seconds: int = 600, watermark: str = "1 hour") -> DataFrame:
    """Quality and detection rows of one image at most ``bound_seconds`` apart, on streams or on batches.

    Both inputs need ``ts`` and ``image_id``. Rows meet on image and time bin (a quality row also visits the two
    neighbouring bins), so a very busy image is spread over its bins; the interval condition lets a stream drop old state.
    """
    time_bin = lambda ts: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bound_seconds * 1_000_000))
    q = quality.withWatermark("ts", watermark).select(F.col("image_id").alias("q_image"), F.col("ts").alias("q_ts"), "quality")
    q = q.withColumn("q_bin", F.explode(F.sequence(time_bin("q_ts") - 1, time_bin("q_ts") + 1)))
    d = detections.withWatermark("ts", watermark).withColumn("d_bin", time_bin("ts"))
    span = f"interval {bound_seconds} seconds"
    near = F.expr(f"image_id = q_image and d_bin = q_bin and ts >= q_ts - {span} and ts <= q_ts + {span}")
    return d.join(q, near).drop("q_image", "q_bin", "d_bin")


class MetadataUpsert:
    """``foreachBatch`` writer of section updates (image_id, ts, sections...).

    A micro-batch adds its own rows as one immutable folder and then a new version of the table that names it; a replayed batch replaces
    its folder in the next version, so every batch counts exactly once. Reading takes the newest value of every section; ``compact`` folds
    finished batches into a base so that reads stay cheap. Versions are swapped by one rename (``Snapshots``): a reader during a replay or a
    compaction sees the version before or the one after, whole.
    """

    def __init__(self, folder: str):
        self.table = Snapshots(folder)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        own = [s for s in batch.columns if s not in ("image_id", "ts")]
        told = lambda s: F.when(F.col(s).isNotNull(), F.col("ts"))
        newest = batch.groupBy("image_id").agg(*[e for s in own for e in (F.max_by(s, told(s)).alias(s), F.max(told(s)).alias(f"{s}__at"))])
        held = lambda entries: any(e["kind"] == "base" and batch_id <= e["upto"] for e in entries)
        if held(self.table.latest(batch.sparkSession)[1]):  # a base holds this batch: it has counted
            return
        entry = {"kind": "batch", "batch_id": batch_id, "path": self.table.write(newest.withColumn("batch_id", F.lit(batch_id).cast("bigint")))}
        self.table.commit(batch.sparkSession, lambda now: now if held(now) else [*(e for e in now if e.get("batch_id") != batch_id), entry])

    def read(self, spark: SparkSession) -> DataFrame:
        """Current sections, one row per image: the value with the newest time of its own, of equal times that of the last batch."""
        current = self._current(spark)
        return current.select([c for c in current.columns if not c.endswith("__at")])

    def _current(self, spark: SparkSession, entries: Entries | None = None) -> DataFrame:
        entries = self.table.latest(spark)[1] if entries is None else entries
        rows = spark.read.option("mergeSchema", "true").parquet(*[f"{self.table.folder}/{e['path']}" for e in entries])
        sections = [c for c in rows.columns if c not in ("image_id", "batch_id") and not c.endswith("__at")]
        return rows.groupBy("image_id").agg(*[
            e for s in sections for e in (
                F.max_by(s, F.when(F.col(s).isNotNull(), F.struct(f"{s}__at", "batch_id"))).alias(s), F.max(f"{s}__at").alias(f"{s}__at"))])

    def compact(self, spark: SparkSession) -> None:
        """Fold all batches so far into a base."""
        entries = self.table.latest(spark)[1]
        upto = max((e.get("batch_id", e.get("upto")) for e in entries), default=None)
        if upto is None:
            return
        rows = self._current(spark, entries).withColumn("batch_id", F.lit(upto).cast("bigint"))
        base = {"kind": "base", "upto": upto, "path": self.table.write(rows)}
        self.table.commit(spark, lambda now: [base, *(e for e in now if e["kind"] == "batch" and e["batch_id"] > upto)])



def metric_monitor(
    metrics: DataFrame, patience: int = 10, min_delta: float = 0.001, width: int = 20, watermark: str = "1 day", idle_ms: int = 7 * 86_400_000
) -> DataFrame:
    """Per run: best value, epochs waited, mean of the last values, and ``improve`` / ``wait`` / ``stop`` per epoch.

    Input run_id, epoch, value, ts. Epochs must rise; a late epoch (not above the last one seen) is dropped. State per run
    is the best value, a counter and the last ``width`` values; it goes away once the watermark is ``idle_ms`` past the
    last row of a run, which starts anew if it comes back. Rows later than the watermark are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, waited, recent, last = state.get if state.exists else (0.0, 0, "", -1)
        window = [float(v) for v in recent.split(",") if v]
        rows = []
        arrived = pd.concat([b[["epoch", "value", "ts"]] for b in batches]).sort_values("epoch")  # one micro-batch of one run
        for epoch, value in arrived[["epoch", "value"]].itertuples(index=False):
            if epoch <= last:
                continue
            last = int(epoch)
            window = [*window, float(value)][-width:]
            better = value > best + min_delta
            best, waited = (float(value), 0) if better else (best, waited + 1)
            event = "improve" if better else ("stop" if waited >= patience else "wait")
            rows.append((key[0], last, float(value), best, waited, sum(window) / len(window), event))
        state.update((best, waited, ",".join(map(repr, window)), last))
        newest = int(arrived.ts.astype("datetime64[us]").max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "epoch", "value", "best", "waited", "avg20", "event"])

    return metrics.withWatermark("ts", watermark).groupBy("run_id").applyInPandasWithState(
        step, MONITOR_OUT, MONITOR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class ProgressLog(StreamingQueryListener):
    """Callback hooks: collects progress of finished micro-batches and calls ``on_end`` when a query stops."""

    def __init__(self, on_batch=None, on_end=None):
        self.batches, self.on_batch, self.on_end = [], on_batch, on_end

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches.append(event.progress.batchId)
        if self.on_batch:
            self.on_batch(event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.on_end:
            self.on_end(event)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process everything available and return the collected output table (tests and small looks)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
