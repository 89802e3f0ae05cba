"""Detector evaluation, losses and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.geometry import Box
from fieldlens.operators import evaluation as E
from fieldlens.operators import states as S
from fieldlens.operators.selection import class_name
from fieldlens.plans.matching_queries import _GREEDY
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables
from fieldlens.schemas import AREA_RANGES, IOU_THRESHOLDS


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _flags(t: Tables, n: int = 10) -> DataFrame:
    """A match table made by a rule over the second run: tp and ignored flags per threshold."""
    rule = t.candidate.withColumns({"_v": (F.col("image_id") * 7 + F.col("det_id") * 3) % 11, "_skip": (F.col("image_id") + F.col("det_id")) % 17 == 0})
    numbers = F.array(*[F.lit(i) for i in range(n)])
    tp = F.transform(numbers, lambda i: (F.col("_v") > i).cast("int"))
    ignored = F.transform(numbers, lambda i: (F.col("_skip") & (F.col("_v") <= i)).cast("int"))
    return rule.select("image_id", "class_id", "det_id", F.col("det_id").alias("det_rank"), "confidence",
                       F.lit("all").alias("area_range"), tp.alias("tp"), ignored.alias("ignored"))


def _truth_counts(t: Tables) -> DataFrame:
    return t.boxes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_truths")).withColumn("area_range", F.lit("all"))


_RULE = """
with thr as (select i, 0.5+0.05*i as threshold from (select unnest(range(10)) as i)),
m as (select image_id, class_id, det_id, confidence, i, cast((image_id*7+det_id*3)%11 > i as int) as tp,
  cast((image_id+det_id)%17=0 and (image_id*7+det_id*3)%11 <= i as int) as ig from candidate, thr),
n as (select class_id, count(*) as npos from detections group by 1),
c as (select m.*, npos, sum(tp) over w as ctp, sum((1-tp)*(1-ig)) over w as cfp from m join n using (class_id)
  window w as (partition by class_id, i order by confidence desc, image_id, det_id rows unbounded preceding)),
e as (select *, ctp/(ctp+cfp) as prec, ctp/npos as rec from c where tp=1),
pts as (select unnest(range(101)) as j),
grid as (select class_id, i, j, coalesce(max(prec) filter (rec >= j*0.01::double), 0) as precision,
    case when j=0 then (select max(confidence) from candidate k where k.class_id=n.class_id) else coalesce(max(confidence) filter (rec >= j*0.01::double), 0) end as score
  from n cross join thr cross join pts left join e using (class_id, i) group by 1, 2, 3, n.class_id)
"""


@query("A-17 W-06 F-04", _RULE + f"""
select class_id, cast(i as int) as thr_no, {r6('avg(precision)')} as ap, {r6('max(precision)')} as best from grid group by 1, 2""")
def average_precision(t: Tables) -> DataFrame:
    table = E.precision_table(_flags(t), _truth_counts(t), IOU_THRESHOLDS, t.candidate)
    return _round(table.groupBy("class_id", "thr_no").agg(F.avg("precision").alias("ap"), F.max("precision").alias("best")), "ap", "best")


@query("F-04 A-17", f"""
with m as (select class_id, 99 - greatest(least(cast(floor(confidence*100) as int), 99), 0) as bin, cast((image_id*7+det_id*3)%11 > 0 as int) as tp,
  cast((image_id+det_id)%17=0 and (image_id*7+det_id*3)%11 <= 0 as int) as ig from candidate),
h as (select class_id, bin, sum(tp) as tp, sum((1-tp)*(1-ig)) as fp from m group by 1, 2),
c as (select class_id, bin, fp, sum(tp) over w as t, sum(fp) over w as g from h window w as (partition by class_id order by bin)),
n as (select class_id, count(*) as npos from detections group by 1),
e as (select class_id, t/npos as rec, t/(t+g) as low, t/(t+g-fp) as high from c join n using (class_id) where t > 0),
p as (select class_id, j, coalesce(max(low) filter (rec >= j*0.01::double), 0) as low, coalesce(max(high) filter (rec >= j*0.01::double), 0) as high
  from n cross join (select unnest(range(101)) as j) left join e using (class_id) group by 1, 2)
select class_id, {r6('avg(low)')} as low, {r6('avg(high)')} as high from p group by 1""")
def average_precision_bounds(t: Tables) -> DataFrame:
    """Average precision at the first threshold from states made for each of 64 parts of the images and merged."""
    flag = lambda c: F.get(c, F.lit(0))
    parts = _flags(t, 1).withColumn("part", F.pmod("image_id", F.lit(64)))
    per_part = S.hit_states(parts, ["class_id", "part"], F.col("confidence"), flag("tp"), flag("ignored"))
    states = S.merged_states(per_part, ["class_id"], 2 * S.SCORE_BINS)
    both = _truth_counts(t).join(states, "class_id", "left").withColumn("state", F.coalesce("state", F.array_repeat(F.lit(0).cast("bigint"), 2 * S.SCORE_BINS)))
    return _round(both.withColumn("ap", S.state_precision("state", "n_truths")).select("class_id", "ap.low", "ap.high"), "low", "high")


@query("A-17", _RULE + f"""
select class_id, cast(j as int) as recall_no, {r6('precision')} as precision, {r6('score')} as score from grid where i = 3""")
def precision_at_recall(t: Tables) -> DataFrame:
    table = E.precision_table(_flags(t), _truth_counts(t), IOU_THRESHOLDS, t.candidate)
    return _round(table.filter("thr_no = 3").select("class_id", "recall_no", "precision", "score"), "precision", "score")


@query("A-18", _RULE + f""",
f as (select j, avg(case when precision + j*0.01::double = 0 then null else 2*precision*(j*0.01::double)/(precision+j*0.01::double) end) as f1 from grid where i=0 group by 1),
b as (select j as bj from f order by f1 desc nulls last, j limit 1),
r as (select case class_id when 0 then 'bird' when 1 then 'head' when 2 then 'eye' else 'beak' end as class, grid.*, bj from grid, b)
select class, {r6('avg(precision)')} as ap, {r6('avg(precision) filter (i=0)')} as ap50, {r6('avg(precision) filter (i=0 and j=bj)')} as precision,
  {r6('max(bj*0.01::double)')} as recall, {r6('avg(score) filter (i=0 and j=bj)')} as score_threshold from r group by 1
union all select 'all', {r6('avg(precision)')}, {r6('avg(precision) filter (i=0)')}, {r6('avg(precision) filter (i=0 and j=bj)')},
  {r6('max(bj*0.01::double)')}, {r6('avg(score) filter (i=0 and j=bj)')} from r""")
def class_report(t: Tables) -> DataFrame:
    table = E.precision_table(_flags(t), _truth_counts(t), IOU_THRESHOLDS, t.candidate)
    return _round(E.class_report(table, class_name(F.col("class_id"))), "ap", "ap50", "precision", "recall", "score_threshold")


@query("W-05 W-06", f"""
with m as (select image_id, class_id, det_id, confidence, cast((image_id*7+det_id*3)%11 > 0 as int) as tp,
  cast((image_id+det_id)%17=0 and (image_id*7+det_id*3)%11 <= 0 as int) as ig from candidate),
n as (select class_id, count(*) as npos from detections group by 1),
c as (select m.*, npos, sum(tp) over w as ctp, sum((1-tp)*(1-ig)) over w as cfp from m join n using (class_id)
  window w as (partition by class_id order by confidence desc, image_id, det_id rows unbounded preceding)),
p as (select *, ctp/(ctp+cfp) as prec from c where ig = 0)
select class_id, image_id, det_id, cast(ctp as bigint) as ctp, cast(cfp as bigint) as cfp, {r6('ctp/npos')} as recall,
  {r6('max(prec) over (partition by class_id order by confidence desc, image_id, det_id rows between current row and unbounded following)')} as envelope from p""")
def precision_recall_curve(t: Tables) -> DataFrame:
    curve = E.pr_curve(_flags(t, 1), _truth_counts(t))
    return _round(curve.select("class_id", "image_id", "det_id", "ctp", "cfp", "recall", "envelope"), "recall", "envelope")


@query("D-08 J-06 A-17 A-18", _GREEDY.replace("select pr.image_id", "\n, fin as (select pr.image_id", 1)[: _GREEDY.replace("select pr.image_id", "\n, fin as (select pr.image_id", 1).rindex("group by 1, 2, 3")] + f"""group by 1, 2, 3),
m as (select f.*, c.confidence, i, case when i=0 then tp50 else tp75 end as tp from fin f join candidate c using (image_id, class_id, det_id), (select unnest([0, 1]) as i)),
n as (select class_id, count(*) as npos from detections group by 1),
c as (select m.*, npos, sum(tp) over w as ctp, sum(1-tp) over w as cfp from m join n using (class_id)
  window w as (partition by class_id, i order by confidence desc, image_id, det_id rows unbounded preceding)),
e as (select *, ctp/(ctp+cfp) as prec, ctp/npos as rec from c where tp=1),
grid as (select n.class_id, h.i, j, coalesce(max(prec) filter (rec >= j*0.01::double), 0) as precision
  from n cross join (select unnest([0, 1]) as i) h cross join (select unnest(range(101)) as j) left join e on e.class_id=n.class_id and e.i=h.i group by 1, 2, 3)
select class_id, case when i=0 then 0.5::double else 0.75::double end as threshold, {r6('avg(precision)')} as ap,
  {r6('(select max(rec) from e where e.class_id=grid.class_id and e.i=grid.i)')} as max_recall from grid group by class_id, i""")
def evaluated_detections(t: Tables) -> DataFrame:
    """End to end: exclusive matching of the second run against the truths, then average precision."""
    table, _ = E.evaluate_detections(t.candidate, t.detections, thresholds=(0.5, 0.75))
    return _round(table.groupBy("class_id", "threshold").agg(F.avg("precision").alias("ap"), F.max("max_recall").alias("max_recall")), "ap", "max_recall")


@query("A-17")
def evaluation_summary(t: Tables) -> DataFrame:
    """All thresholds, all area ranges: the twelve summary statistics (checked by brute force in the tests)."""
    table, recalls = E.evaluate_detections(t.candidate, t.detections, areas=tuple(AREA_RANGES))
    return _round(E.summary_statistics(table, recalls), "value")


_QUERY_ROWS = """(select image_id, query_id, class_id, logit, (image_id+query_id)%3=0 and class_id=query_id%4 as positive,
  0.5+(query_id%5)/10 as iou from logits)"""


def _query_rows(t: Tables) -> DataFrame:
    return t.logits.withColumns({
        "positive": ((F.col("image_id") + F.col("query_id")) % 3 == 0) & (F.col("class_id") == F.col("query_id") % 4),
        "iou": F.lit(0.5) + (F.col("query_id") % 5) / 10,
    })


@query("A-27", f"""
with r as (select *, 1/(1+exp(-logit)) as p, case when positive then iou else 0 end as tg, greatest(logit,0) + ln(1+exp(-abs(logit))) as sp,
  least(logit,0) - ln(1+exp(-abs(logit))) as ls, max(case when positive then iou else 0 end) over (partition by image_id) as best from {_QUERY_ROWS}),
s as (select *, tg/(best+1e-8) as ps, greatest(pow(p,0.25)*pow(iou,0.75), 0.01) as tt from r)
select {r6("sum(case when positive then 0.25*(sp-logit)*pow(1-p,2) else 0.75*sp*pow(p,2) end)/count(*) filter (positive)")} as focal,
  {r6("sum((sp-logit*tg)*case when tg>0 then tg else 0.75*pow(p,2) end)/count(*) filter (positive)")} as varifocal,
  {r6("sum((sp-logit*ps)*pow(abs(ps-p),2)*case when ps>0 then 0.25 else 0.75 end)/count(*) filter (positive)")} as position,
  {r6("sum(case when positive then (1-tt)*logit-ls else pow(p,2)*logit-ls*pow(p,2) end)/count(*) filter (positive)")} as iou_aware from s""")
def classification_losses(t: Tables) -> DataFrame:
    return _round(E.classification_losses(_query_rows(t)), "focal", "varifocal", "position", "iou_aware")


_UNIT_PAIRS = """(select image_id, det_id, a.angle, a.x1/width as x1, a.y1/height as y1, a.x2/width as x2, a.y2/height as y2,
  b.x1/width as u1, b.y1/height as v1, b.x2/width as u2, b.y2/height as v2 from detections a join candidate b using (image_id, det_id) join images using (image_id))"""


def _unit_pairs(t: Tables) -> DataFrame:
    other = t.candidate.select("image_id", "det_id", *Box.of().named(suffix="_b"))
    both = t.detections.join(other, ["image_id", "det_id"]).join(t.images.select("image_id", "width", "height"), "image_id")
    side = lambda c: F.col("width") if c.startswith("x") else F.col("height")
    return both.select("image_id", "det_id", "angle", *[(F.col(c) / side(c)).alias(c) for c in (*Box._fields, *[f"{k}_b" for k in Box._fields])])


@query("A-25 G-08", f"""
select {r6('sum(abs((x1+x2)/2-(u1+u2)/2)+abs((y1+y2)/2-(v1+v2)/2)+abs((x2-x1)-(u2-u1))+abs((y2-y1)-(v2-v1)))/count(*)')} as loss_bbox,
  {r6('sum(1-(inter/(total-inter)-(hull-(total-inter))/hull))/count(*)')} as loss_giou from (select *,
  greatest(0,least(x2,u2)-greatest(x1,u1))*greatest(0,least(y2,v2)-greatest(y1,v1)) as inter, (x2-x1)*(y2-y1)+(u2-u1)*(v2-v1) as total,
  (greatest(x2,u2)-least(x1,u1))*(greatest(y2,v2)-least(y1,v1)) as hull from {_UNIT_PAIRS})""")
def matched_box_losses(t: Tables) -> DataFrame:
    return _round(E.box_losses(_unit_pairs(t)), "loss_bbox", "loss_giou")


@query("A-26", f"""
select {r6('sum(case when det_id%3<>0 then 1-cos(angle+cast(0.1 as double)-angle) end)/(count(*)+1e-6)')} as loss_orient from {_UNIT_PAIRS}""")
def orientation_error(t: Tables) -> DataFrame:
    turned = F.col("angle") + 0.1
    pairs = _unit_pairs(t).select(
        (2 * F.cos(turned)).alias("cos"), (2 * F.sin(turned)).alias("sin"), F.when(F.col("det_id") % 3 != 0, F.col("angle")).alias("angle"))
    return _round(E.orientation_loss(pairs), "loss_orient")


def _query_arrays(t: Tables) -> DataFrame:
    q = t.grids.select("image_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("query_id"))
    return q.select("image_id", "query_id", F.array(*[F.get("cells", F.col("query_id") * 4 + i) * 8 for i in range(4)]).alias("logits"))


@query("A-24", f"""
with b as (select image_id, query_id, first(class_id order by logit desc, class_id) as c from logits group by 1, 2),
f as (select image_id, count(*) filter (c <> 3) as found from b group by 1), w as (select image_id, count(*) as wanted from detections group by 1)
select {r6('avg(abs(found-coalesce(wanted,0)))')} as cardinality_error from f left join w using (image_id)""")
def cardinality_error(t: Tables) -> DataFrame:
    return _round(E.cardinality_error(_query_arrays(t), t.boxes), "cardinality_error")


@query("A-28", f"""
with r as (select image_id, query_id, class_id, row_number() over (partition by image_id, query_id order by logit desc, class_id) as rk from logits)
select {r6('100*avg((rk<=1)::int)')} as acc_1, {r6('100*avg((rk<=2)::int)')} as acc_2, {r6('100-100*avg((rk<=1)::int)')} as class_error
from r where class_id = (image_id+query_id)%4""")
def topk_accuracy(t: Tables) -> DataFrame:
    rows = _query_arrays(t).withColumn("label", ((F.col("image_id") + F.col("query_id")) % 4).cast("int"))
    return _round(E.topk_accuracy(rows, (1, 2)), "acc_1", "acc_2", "class_error")


@query("A-19", f"""
with r as (select pred, label, rank() over (order by pred) + (count(*) over (partition by pred) - 1)/2 as rp,
  rank() over (order by label) + (count(*) over (partition by label) - 1)/2 as rl from mos)
select {r6('corr(pred, label)')} as lcc, {r6('corr(rp, rl)')} as srcc from r""")
def score_correlations(t: Tables) -> DataFrame:
    lcc, srcc = E.linear_correlation(t.mos, "pred", "label"), E.rank_correlation(t.mos, "pred", "label")
    return _round(lcc.withColumn("srcc", srcc.scalar()), "lcc", "srcc")


@query("A-19", f"""
with p as (select pred, label, count(*) as n from mos group by 1, 2),
s as (select sum(a.n*b.n*sign((a.pred-b.pred)*(a.label-b.label)))/2 as s from p a, p b),
n as (select count(*)*(count(*)-1)/2 as n0 from mos),
x as (select sum(c*(c-1)/2) as t from (select count(*) as c from mos group by pred)),
y as (select sum(c*(c-1)/2) as t from (select count(*) as c from mos group by label))
select {r6('s/sqrt((n0-x.t)*(n0-y.t))')} as krocc from s, n, x, y""")
def pair_order_correlation(t: Tables) -> DataFrame:
    return _round(E.pair_order_correlation(t.mos, "pred", "label"), "krocc")


@query("A-20", f"select is_valid, {r6('avg(pow(pred-label, 2))')} as mse from mos group by 1")
def mean_loss(t: Tables) -> DataFrame:
    return _round(E.mean_squared_error(t.mos, "pred", "label", ["is_valid"]), "mse")
