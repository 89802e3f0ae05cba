"""Model comparison, timings, metric logs and processing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators import compare as M
from fieldlens.operators import events as V
from fieldlens.operators import training as L
from fieldlens.operators.selection import class_name, first_per_key
from fieldlens.plans.matching_queries import _BEST
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables
from fieldlens.sources import logs
from fieldlens.streaming.jobs import stage_join

C = F.col


def _r(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_r(C(c), c) if c in names else C(c) for c in df.columns])


# ---- model variants ------------------------------------------------------------------------------------------------

_DIFF = """(select image_id, max(abs(base-quant)) as max_absolute_diff, avg(abs(base-quant)) as mean_absolute_diff, sqrt(avg(pow(base-quant,2))) as rmse,
  max(abs(base-quant)/(abs(base)+1e-8)) as relative_error, sum(base*quant)/(sqrt(sum(base*base))*sqrt(sum(quant*quant))+1e-8) as cosine_similarity
  from model_outputs group by 1)"""


def _differences(t: Tables) -> DataFrame:
    base = t.grids.select("image_id", C("cells").alias("values"))
    quant = t.grids.select("image_id", F.expr("transform(cells, v -> round(v*127)/127)").alias("values"))
    return M.output_differences(M.pair_outputs(base, quant))


@query("A-12 J-13", f"select image_id, {', '.join(f'{r6(c)} as {c}' for c in M.DIFFERENCES)}, true as same_shape from {_DIFF}")
def output_differences(t: Tables) -> DataFrame:
    return _rounded(_differences(t), *M.DIFFERENCES)


@query("A-13", " union all ".join(f"select '{c}' as metric, {r6(f'avg({c})')} as avg_value, {r6(f'max({c})')} as max_value from {_DIFF}" for c in M.DIFFERENCES))
def difference_rollup(t: Tables) -> DataFrame:
    return _rounded(M.difference_rollup(_differences(t)), "avg_value", "max_value")


@query("A-13", f"select max(max_absolute_diff) <= 0.01 as passed from {_DIFF}")
def outputs_within_tolerance(t: Tables) -> DataFrame:
    return M.within_tolerance(_differences(t), 0.01)


@query("A-14", f"""
select series, count(*) as runs, {r6('avg(ms)')} as mean, {r6('median(ms)')} as median, min(ms) as min, max(ms) as max, {r6('coalesce(stddev_samp(ms), 0)')} as stdev
from timings group by 1""")
def timing_summary(t: Tables) -> DataFrame:
    return _rounded(M.timing_summary(t.timings), "mean", "median", "stdev")


@query("A-15", f"""
select series, {r6('avg(ms)')} as mean_ms, {r6('stddev_pop(ms)')} as std_ms, min(ms) as min_ms, max(ms) as max_ms from timings where run_no > 0 group by 1""")
def warm_timing_summary(t: Tables) -> DataFrame:
    return _rounded(M.warm_timing_summary(t.timings), "mean_ms", "std_ms")


@query("A-16 W-14", f"""
with m as (select p_type as family, p_partkey as model_no, cast(round(p_retailprice*10000) as bigint) as bytes from part)
select family, model_no, {r6('bytes/1048576')} as size_mb, {r6('(first(bytes) over w - bytes)*100.0::double/first(bytes) over w')} as reduction_percent,
  {r6('first(bytes) over w/bytes')} as compression_ratio from m window w as (partition by family order by model_no rows between unbounded preceding and unbounded following)""".replace("first(bytes)", "first_value(bytes)"))
def size_report(t: Tables) -> DataFrame:
    models = t.raw("part").select(C("p_type").alias("family"), C("p_partkey").alias("model_no"), F.round(C("p_retailprice") * 10000).cast("bigint").alias("bytes"))
    return _rounded(M.size_report(models, ["family"]).drop("bytes"), "size_mb", "reduction_percent", "compression_ratio")


@query("D-07 J-04", f"select image_id, {r6('avg(iou)')} as mean_iou, count(*) filter (match_id is null) as unmatched from {_BEST} group by 1")
def run_average_iou(t: Tables) -> DataFrame:
    return _rounded(M.average_iou(t.detections, t.candidate, t.boxes), "mean_iou")


@query("D-07 A-12 A-13 A-15 A-16", f"""
with w as (select series as model, avg(ms) as mean_ms, stddev_pop(ms) as std_ms from timings where run_no > 0 group by 1),
s as (select event_type as model, count(*) as bytes, min(event_id) as model_no from events group by 1),
d as (select model, avg(cosine_similarity) as cosine, avg(rmse) as rmse, max(max_absolute_diff) as max_diff from
  (select x.*, e.event_type as model from {_DIFF} x join events e on e.event_id = x.image_id) group by 1)
select model, {r6('bytes/1048576')} as size_mb, {r6('mean_ms')} as mean_ms, {r6('std_ms')} as std_ms, {r6('coalesce(cosine,1)')} as cosine, {r6('coalesce(rmse,0)')} as rmse,
  {r6('coalesce(max_diff,0)')} as max_diff, {r6('((select first(bytes order by model_no) from s)-bytes)*100.0::double/(select first(bytes order by model_no) from s)')} as reduction_percent
from s left join w using (model) left join d using (model)""")
def performance_table(t: Tables) -> DataFrame:
    sizes = M.size_report(t.raw("events").groupBy(C("event_type").alias("model")).agg(F.count(F.lit(1)).alias("bytes"), F.min("event_id").alias("model_no")))
    timings = M.warm_timing_summary(t.timings).withColumnRenamed("series", "model")
    run = t.raw("events").select(C("event_id").alias("image_id"), C("event_type").alias("model"))  # the model that made each output
    rollup = M.difference_rollup(_differences(t).join(run, "image_id"), by=["model"])
    return _rounded(M.performance_table(sizes, timings, rollup), "size_mb", "mean_ms", "std_ms", "cosine", "rmse", "max_diff", "reduction_percent")


# ---- metric logs ---------------------------------------------------------------------------------------------------

@query("W-03", "select run_id, class, epoch, value, max(value) over (partition by run_id, class order by epoch) as best from metric_log")
def running_best(t: Tables) -> DataFrame:
    return L.running_best(t.metric_log, ["run_id", "class"])


@query("W-04 U-05", """
with l as (select 'regular' as series, * from metric_log union all select 'ema', run_id, epoch, class, round(value*0.9+0.05*(epoch%3), 6) from metric_log),
r as (select *, row_number() over (partition by series, class order by value desc, epoch) as rn from l)
select series, class, epoch, value as best from r where rn = 1
union all select * from (select 'all', 'all', epoch, value from l order by value desc, epoch limit 1)""")
def best_epochs(t: Tables) -> DataFrame:
    ema = t.metric_log.withColumn("value", F.round(C("value") * F.lit(0.9) + F.lit(0.05) * (C("epoch") % 3), 6))
    log = L.with_series(t.metric_log, ema)
    overall = L.best_epoch(log).withColumns({"series": F.lit("all"), "class": F.lit("all")})
    return L.best_epoch(log, ["series", "class"]).unionByName(overall)


@query("W-07 T-07", f"""
with w as (select series, run_no, ms, avg(ms) over t as a, max(ms) over t as m, list_sort(list(ms) over t) as l, sum(ms) over u as s, count(*) over u as n from timings
  window t as (partition by series order by run_no rows between 19 preceding and current row), u as (partition by series order by run_no rows unbounded preceding))
select series, run_no, ms, {r6('a')} as avg, l[(len(l)-1)//2+1] as median, m as max, {r6('s/n + 1e-9')} as global_avg from w""")
def smoothed_values(t: Tables) -> DataFrame:
    d = L.smoothed(t.timings, ["series"], "run_no", "ms")
    return _rounded(d.withColumn("global_avg", C("global_avg") + 1e-9), "avg", "global_avg")  # the shift avoids exact halves


_CUR = """e as (select run_id, epoch, greatest(max(value), round(avg(value)*1.02,6)) as value from metric_log group by 1, 2),
s as (select *, row_number() over (partition by run_id order by epoch) as rn from e)"""


def _tracked(t: Tables) -> DataFrame:
    per_epoch = t.metric_log.groupBy("run_id", "epoch").agg(F.max("value").alias("regular"), F.round(F.avg("value") * 1.02, 6).alias("ema"))
    return per_epoch.select("run_id", "epoch", L.tracked_metric().alias("value"))


@query("W-08 T-07", f"""
with recursive {_CUR}, f as (
 select run_id, cast(0 as bigint) as rn, cast(null as int) as epoch, cast(0 as double) as value, cast(0 as double) as best, cast(0 as bigint) as waited from (select distinct run_id from s)
 union all select s.run_id, s.rn, s.epoch, s.value, case when s.value > f.best + 0.002::double then s.value else f.best end, case when s.value > f.best + 0.002::double then 0 else f.waited+1 end
 from f join s on s.run_id=f.run_id and s.rn=f.rn+1)
select run_id, epoch, value, best, waited, waited >= 5 as stop from f where rn > 0""")
def early_stop_trace(t: Tables) -> DataFrame:
    return L.early_stop_trace(_tracked(t), ["run_id"], patience=5, min_delta=0.002)


@query("D-09 S-11 W-03 W-04", """
select run_id, best, epoch, n_epochs from (select run_id, value as best, epoch, count(*) over (partition by run_id) as n_epochs,
  row_number() over (partition by run_id order by value desc, epoch) as rn from (select run_id, epoch, max(value) as value from metric_log group by 1, 2)) where rn = 1""")
def training_report(t: Tables) -> DataFrame:
    per_epoch = t.metric_log.groupBy("run_id", "epoch").agg(F.max("value").alias("value"))
    return L.training_report(per_epoch, ["run_id"])


@query("S-11", """
select run_id, epoch, series, class, metric, value from (select run_id, epoch, class, value from metric_log) m,
 (values ('regular','map@50:95'),('ema','map@50:95'),('ema','map@50')) v(series, metric)""")
def metric_log_rows(t: Tables) -> DataFrame:
    """Nested log lines, one document per run and epoch, back to flat rows."""
    entry = F.struct("class", C("value").alias("map@50:95"))
    ema = F.struct("class", C("value").alias("map@50:95"), C("value").alias("map@50"))
    docs = t.metric_log.groupBy("run_id", "epoch").agg(F.collect_list(entry).alias("r"), F.collect_list(ema).alias("e"))
    lines = docs.select("run_id", F.to_json(F.struct("epoch", F.struct(C("r").alias("class_map")).alias("test_results_json"),
                                                     F.struct(C("e").alias("class_map")).alias("ema_test_results_json"))).alias("value"))
    return logs.metric_rows(logs.parse_metric_lines(lines))


@query("S-12", """
select run_id as split, count(*) as n_classes, max(value) as best from (select run_id, class, max(value) as value from metric_log group by 1, 2) group by 1""")
def results_by_split(t: Tables) -> DataFrame:
    report = t.metric_log.groupBy(C("run_id").alias("split"), "class").agg(F.max("value").alias("map"))
    doc = logs.results_document(report)
    rows = F.explode(F.from_json("document", "class_map map<string,array<struct<class:string,map:double>>>")["class_map"])
    return doc.select(rows.alias("split", "m")).select("split", F.size("m").cast("bigint").alias("n_classes"), F.array_max(F.transform("m", lambda e: e["map"])).alias("best"))


_LINE = """case event_id%4 when 0 then concat('[I] Latency: min = ', cast(value+0.25 as {s}), ' ms, max = ', cast(value+9.25 as {s}), ' ms, mean = ', cast(value+1.25 as {s}), ' ms, median = 1.0 ms')
 when 1 then concat('[I] Throughput: ', cast(value+0.25 as {s}), ' qps') when 2 then concat('Inference completed in ', cast(value as {s}), 'ms') else concat('Loaded model (', cast(event_id as {s}), ' bytes) in ', cast(value as {s}), 'ms') end"""


@query("X-14", f"""
select event_id, round(case when event_id%4=0 then value+0.25 end, 6) as latency_min, round(case when event_id%4=0 then value+1.25 end, 6) as latency_mean,
 round(case when event_id%4=1 then value+0.25 end, 6) as qps, round(case when event_id%4=2 then value end, 6) as inference_ms, round(case when event_id%4=3 then value end, 6) as load_ms from events""")
def log_line_fields(t: Tables) -> DataFrame:
    line = t.raw("events").select("event_id", F.expr(_LINE.format(s="string")).alias("line"))
    l = C("line")
    cols = {"latency_min": text.log_field(l, "latency", "min_ms"), "latency_mean": text.log_field(l, "latency", "mean_ms"), "qps": text.log_throughput(l),
            "inference_ms": text.log_duration(l, "completed in"), "load_ms": text.log_duration(l, "Loaded")}
    return line.select("event_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


# ---- processing events ---------------------------------------------------------------------------------------------

@query("T-02", "select path, kind as status from (select *, row_number() over (partition by path order by ts desc, event_id desc) as rn from run_events) where rn = 1")
def image_status(t: Tables) -> DataFrame:
    return V.latest_status(t.run_events).select("path", "status")


@query("T-03", f"""
select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M') as window_start, count(*) filter (kind <> 'error') as n_ok, count(*) filter (kind = 'error') as n_failed,
  {r6("avg(ms) filter (kind <> 'error')")} as ms_per_ok from run_events group by 1""")
def daily_throughput(t: Tables) -> DataFrame:
    return V.throughput(t.run_events, "1 day").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n_ok", "n_failed", _r(C("ms_per_ok"), "ms_per_ok"))


@query("T-03", f"""
select strftime(time_bucket(interval '6 hours', ts) - s*interval '6 hours', '%Y-%m-%d %H:%M') as window_start, count(*) filter (kind <> 'error') as n_ok,
  count(*) filter (kind = 'error') as n_failed, {r6("avg(ms) filter (kind <> 'error')")} as ms_per_ok from run_events, (select unnest([0,1,2,3]) as s) group by 1""")
def sliding_throughput(t: Tables) -> DataFrame:
    return V.throughput(t.run_events, "24 hours", "6 hours").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n_ok", "n_failed", _r(C("ms_per_ok"), "ms_per_ok"))


@query("T-04", """
with p as (select *, lag(ts) over (partition by run_id order by ts, event_id) as prev from run_events),
s as (select *, sum(case when prev is null or ts >= prev + interval '2 hours' then 1 else 0 end) over (partition by run_id order by ts, event_id) as session_no from p)
select run_id, cast(session_no as bigint) as session_no, count(*) as n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts from s group by 1, 2""")
def run_sessions(t: Tables) -> DataFrame:
    s = V.run_sessions(t.run_events, 7200)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("run_id", "session_no", "n_events", stamp("first_ts"), stamp("last_ts"))


@query("T-06", "select path, event_id from (select *, row_number() over (partition by path order by ts, event_id) as rn from run_events) where rn = 1")
def first_events(t: Tables) -> DataFrame:
    """Batch form of the streaming dedupe: one event per path, the first."""
    return first_per_key(t.run_events.select("path", "event_id", "ts"), ["path"], [C("ts"), C("event_id")]).select("path", "event_id")


@query("T-09", """
select q.run_id as image_id, q.event_id as quality_event, d.event_id as detection_event from run_events q join run_events d on q.run_id=d.run_id
 and d.ts >= q.ts - interval '5400 seconds' and d.ts <= q.ts + interval '5400 seconds' where q.kind='view' and d.kind='click'""")
def stage_pairs(t: Tables) -> DataFrame:
    """Batch form of the stage join: views and clicks of one run at most ninety minutes apart."""
    side = lambda kind, name: t.run_events.filter(C("kind") == kind).select(C("run_id").alias("image_id"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias(name))
    q = side("view", "quality")
    return stage_join(q, side("click", "detection_event"), 5400).select("image_id", C("quality").alias("quality_event"), "detection_event")


@query("A-31", f"""
with r as (select event_id, value as ms, unnest(case when event_type='purchase' then ['detect','cutout'] when event_type in ('click','view') then ['detect'] else ['cutout'] end) as tool from events)
select tool, count(*) as invocations, {r6('sum(ms)')} as total_ms from r group by 1""")
def tool_usage(t: Tables) -> DataFrame:
    tools = F.expr("case when event_type='purchase' then array('detect','cutout') when event_type in ('click','view') then array('detect') else array('cutout') end")
    return _rounded(V.tool_usage(t.raw("events").select("event_type", "event_id", C("value").alias("ms")), tools), "total_ms")


@query("A-31", "select event_id, value as ms from events order by value desc, event_id limit 5")
def slowest_runs(t: Tables) -> DataFrame:
    return V.slowest_runs(t.raw("events").select("event_id", C("value").alias("ms")))


@query("A-32", f"""
select source_type, class_name, count(*) as n, {r6('avg(confidence)')} as mean_confidence, cast(grouping_id(source_type, class_name) as int) as level from
 (select source_type, case class_id when 0 then 'bird' when 1 then 'head' when 2 then 'eye' else 'beak' end as class_name, confidence from detections join images using (image_id))
group by cube (source_type, class_name)""")
def provenance_rollup(t: Tables) -> DataFrame:
    d = t.boxes.join(t.images.select("image_id", "source_type"), "image_id").withColumn("class_name", class_name(C("class_id")))
    return _rounded(V.provenance_rollup(d), "mean_confidence")
