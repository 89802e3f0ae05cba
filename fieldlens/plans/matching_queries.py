"""Joins: quality maps, overlaps, best matches, exclusive matching, assignment, run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.geometry import Box
from fieldlens.operators import matching as M
from fieldlens.operators.selection import class_name
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables

_ONE = ["image_id", "det_id", *Box._fields]

_IOU = """case when least(a.x2,b.x2)<greatest(a.x1,b.x1) or least(a.y2,b.y2)<greatest(a.y1,b.y1) then 0 else
  (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) /
  ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-(least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) end"""


@query("J-02 F-02 T-08", f"""
select d.image_id, d.det_id, {r6('g.q')} as quality from detections d left join (select image_id, avg(v) as q from grid_cells group by 1) g using (image_id)""")
def detections_with_quality(t: Tables) -> DataFrame:
    """Detections keep their row when the image has no quality map."""
    quality = t.grids.select("image_id", (F.aggregate("cells", F.lit(0.0), lambda s, v: s + v) / F.size("cells")).alias("q"))
    joined = t.detections.select("image_id", "det_id").join(quality, "image_id", "left")
    return joined.select("image_id", "det_id", (F.round("q", 6) + F.lit(0.0)).alias("quality"))


@query("J-03", f"""
select a.image_id, a.det_id as det_a, b.det_id as det_b, {r6(_IOU)} as iou from detections a join candidate b
on a.image_id = b.image_id and {_IOU} > 0.3""")
def overlapping_pairs(t: Tables) -> DataFrame:
    cols = ["image_id", "det_id", *Box._fields]
    pairs = M.overlap_pairs(t.detections.select(cols), t.candidate.select(cols), ["image_id"], 0.3)
    return pairs.select("image_id", F.col("det_id").alias("det_a"), F.col("det_id_b").alias("det_b"), (F.round("iou", 6) + F.lit(0.0)).alias("iou"))


_BEST = f"""(select image_id, det_id, class_id, match_id, match_class, coalesce(iou, 0) as iou from (
  select a.image_id, a.det_id, a.class_id, b.det_id as match_id, b.class_id as match_class, {_IOU} as iou,
    row_number() over (partition by a.image_id, a.det_id order by {_IOU} desc nulls last, b.det_id) as rn
  from detections a left join candidate b on a.image_id = b.image_id and {_IOU} > 0) where rn = 1)"""


@query("J-04", f"select image_id, det_id, match_id, {r6('iou')} as iou from {_BEST}")
def best_match_per_detection(t: Tables) -> DataFrame:
    m = M.best_matches(t.detections.select(_ONE), t.candidate, ["image_id"], "det_id", "det_id", crowds=t.boxes)
    return m.select("image_id", "det_id", "match_id", (F.round("iou", 6) + F.lit(0.0)).alias("iou"))


_PRED = f"""(select image_id, det_id, class_id, match_id, match_class, iou from (
  select a.image_id, a.det_id, a.class_id, b.det_id as match_id, b.class_id as match_class, {_IOU} as iou,
    row_number() over (partition by a.image_id, a.det_id order by {_IOU} desc nulls last, b.det_id) as rn
  from candidate a left join detections b on a.image_id = b.image_id and {_IOU} > 0.1) where rn = 1)"""


@query("J-05", f"select image_id, det_id, match_id, {r6('iou')} as iou from {_PRED} where match_id is not null")
def accepted_predictions(t: Tables) -> DataFrame:
    matched, _ = M.accepted_matches(t.candidate.select(_ONE), t.detections, ["image_id"], "det_id", "det_id", 0.1, crowds=t.boxes)
    return matched.select("image_id", "det_id", "match_id", (F.round("iou", 6) + F.lit(0.0)).alias("iou"))


@query("J-05", f"select image_id, det_id from {_PRED} where match_id is null")
def unmatched_predictions(t: Tables) -> DataFrame:
    _, unmatched = M.accepted_matches(t.candidate.select(_ONE), t.detections, ["image_id"], "det_id", "det_id", 0.1, crowds=t.boxes)
    return unmatched.select("image_id", "det_id")


@query("A-23 W-12", f"""
with votes as (select class_id, match_class, count(*) as n from (
   select *, row_number() over (partition by image_id, class_id order by iou desc, det_id) as rn from {_PRED} where match_id is not null) where rn = 1 group by 1, 2),
s as (select *, sum(n) over (partition by class_id) as total, row_number() over (partition by class_id order by n desc, match_class) as rk from votes)
select class_id, match_class, cast(n as bigint) as n, {r6('100.0*n/total')} as percent from s where rk = 1""")
def class_mapping_vote(t: Tables) -> DataFrame:
    matched, _ = M.accepted_matches(t.candidate.select(*_ONE, "class_id"), t.detections, ["image_id"], "det_id", "det_id", 0.1, keep=("class_id",), crowds=t.boxes)
    best = matched.groupBy("image_id", "class_id").agg(
        F.max(F.struct("iou", (-F.col("det_id")).alias("neg"), F.col("match_class_id").alias("cls"))).alias("b"))
    votes = best.groupBy("class_id", F.col("b.cls").alias("match_class")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("class_id")  # one row per pair of classes
    ranked = votes.withColumns({"total": F.sum("n").over(w), "rk": F.row_number().over(w.orderBy(F.col("n").desc(), "match_class"))})
    return ranked.filter("rk = 1").select("class_id", "match_class", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


_ASSIGN = f"""
with recursive q as (select image_id, det_id as query_id, x1/1000 as x1, y1/1000 as y1, x2/1000 as x2, y2/1000 as y2, class_id, 6*confidence-3 as s from candidate),
g as (select image_id, det_id as target_id, class_id, x1/1000 as x1, y1/1000 as y1, x2/1000 as x2, y2/1000 as y2 from detections),
p as (select a.image_id, a.query_id, b.target_id, 1/(1+exp(-(case when a.class_id=b.class_id then a.s else -a.s end))) as p,
  abs((a.x1+a.x2)/2-(b.x1+b.x2)/2)+abs((a.y1+a.y2)/2-(b.y1+b.y2)/2)+abs((a.x2-a.x1)-(b.x2-b.x1))+abs((a.y2-a.y1)-(b.y2-b.y1)) as l1,
  greatest(0,least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0,least(a.y2,b.y2)-greatest(a.y1,b.y1)) as inter,
  (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) as total,
  (greatest(a.x2,b.x2)-least(a.x1,b.x1))*(greatest(a.y2,b.y2)-least(a.y1,b.y1)) as hull from q a join g b using (image_id)),
c as (select image_id, query_id, target_id, 2*(0.25*pow(1-p,2)*(-ln(p+1e-8)) - 0.75*pow(p,2)*(-ln(1-p+1e-8))) + 5*l1
  - 2*(inter/(total-inter) - (hull-(total-inter))/hull) as cost from p)
"""


def _cost_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    unit = [(F.col(c) / 1000).alias(c) for c in Box._fields]
    score = 6 * F.col("confidence") - 3
    logits = F.array(*[F.when(F.col("class_id") == i, score).otherwise(-score) for i in range(4)])
    queries = t.candidate.select("image_id", F.col("det_id").alias("query_id"), logits.alias("logits"), *unit)
    targets = t.detections.select("image_id", F.col("det_id").alias("target_id"), "class_id", *unit)
    return queries, targets


@query("J-07", _ASSIGN + f"select image_id, cast(query_id as int) as query_id, target_id, {r6('cost')} as cost from c")
def matching_costs(t: Tables) -> DataFrame:
    costs = M.match_costs(*_cost_inputs(t), 2.0, 5.0, 2.0)
    return costs.select("image_id", "query_id", "target_id", (F.round("cost", 6) + F.lit(0.0)).alias("cost"))


@query("J-07", _ASSIGN + f""", e as materialized (select image_id, dense_rank() over (partition by image_id order by query_id) as k,
  cast(1 as bigint) << (dense_rank() over (partition by image_id order by target_id) - 1) as bit, cost from c),
n as (select image_id, max(k) as want from e group by 1),
s as (select image_id, cast(0 as bigint) as k, cast(0 as bigint) as used, cast(0 as double) as total from n
  union all select s.image_id, s.k+1, s.used | e.bit, min(s.total+e.cost) from s join e on e.image_id=s.image_id and e.k=s.k+1 and (s.used & e.bit) = 0 group by 1, 2, 3)
select image_id, cast(k as bigint) as n, {r6('min(total)')} as total_cost from s join n using (image_id) where k = want group by 1, 2""")
def assigned_targets(t: Tables) -> DataFrame:
    """Least total cost of the 1:1 assignment; the check keeps the cheapest way to every set of used targets (queries are never more than targets here)."""
    pairs = M.assign_targets(M.match_costs(*_cost_inputs(t), 2.0, 5.0, 2.0))
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("cost"), 6) + F.lit(0.0)).alias("total_cost"))


@query("J-07", _ASSIGN + f""", e as materialized (select image_id, query_id % 2 as query_group, dense_rank() over (partition by image_id, query_id % 2 order by query_id) as k,
  cast(1 as bigint) << (dense_rank() over (partition by image_id, query_id % 2 order by target_id) - 1) as bit, cost from c),
n as (select image_id, query_group, max(k) as want from e group by 1, 2),
s as (select image_id, query_group, cast(0 as bigint) as k, cast(0 as bigint) as used, cast(0 as double) as total from n
  union all select s.image_id, s.query_group, s.k+1, s.used | e.bit, min(s.total+e.cost) from s join e on e.image_id=s.image_id and e.query_group=s.query_group
    and e.k=s.k+1 and (s.used & e.bit) = 0 group by 1, 2, 3, 4)
select image_id, cast(query_group as int) as query_group, cast(k as bigint) as n, {r6('min(total)')} as total_cost from s join n using (image_id, query_group) where k = want group by 1, 2, 3""")
def assigned_query_groups(t: Tables) -> DataFrame:
    """Each half of an image's queries is a group with an assignment of its own to all targets."""
    queries, targets = _cost_inputs(t)
    grouped = queries.withColumn("query_group", (F.col("query_id") % 2).cast("int"))
    pairs = M.assign_query_groups(grouped, targets, class_weight=2.0, box_weight=5.0, giou_weight=2.0)
    return pairs.groupBy("image_id", "query_group").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("cost"), 6) + F.lit(0.0)).alias("total_cost"))


@query("J-08", "select image_id, det_id from detections where image_id in (select image_id from images where source_type = 'file')")
def annotations_of_split(t: Tables) -> DataFrame:
    chosen = t.images.filter("source_type = 'file'").select("image_id")
    return t.detections.select("image_id", "det_id").join(chosen, "image_id", "left_semi")


@query("J-09", "select image_id, path from images where image_id not in (select image_id from detections where confidence >= 0.5)")
def images_without_detections(t: Tables) -> DataFrame:
    seen = t.boxes.filter("confidence >= 0.5").select("image_id")
    return t.images.select("image_id", "path").join(seen, "image_id", "left_anti")


@query("J-12", f"""
select image_id, max(d) as max_diff, bool_and(d <= 4.01) as within, count(*) as n from (
 select a.image_id, abs(a.x1-b.x1)+abs(a.y1-b.y1)+abs(0) as d from detections a join candidate b using (image_id, det_id)) group by 1""")
def keypoint_run_difference(t: Tables) -> DataFrame:
    from fieldlens.operators.pose import compare_runs

    as_points = lambda d: d.select("image_id", F.col("det_id").alias("joint_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.0).alias("confidence"))
    return compare_runs(as_points(t.detections), as_points(t.candidate), tolerance=4.01)


@query("J-14", "select image_id, det_id, case class_id when 0 then 'bird' when 1 then 'head' when 2 then 'eye' else 'beak' end as class_name from detections")
def category_names(t: Tables) -> DataFrame:
    return t.detections.select("image_id", "det_id", class_name(F.col("class_id")).alias("class_name"))


_GREEDY = f"""
with recursive pr as (select image_id, class_id, det_id, x1, y1, x2, y2,
  cast(row_number() over (partition by image_id, class_id order by confidence desc, det_id) as int) as rk from candidate),
pairs as materialized (select a.image_id, a.class_id, a.rk, b.det_id as gt_id, {_IOU} as iou
  from pr a join detections b on a.image_id=b.image_id and a.class_id=b.class_id and {_IOU} >= 0.5),
thr as (select unnest([0.5::double, 0.75::double]) as t),
states as (
  select image_id, class_id, t, 0 as rk, cast([] as int[]) as taken, cast(null as int) as hit from (select distinct image_id, class_id from pairs), thr
  union all
  select s.image_id, s.class_id, s.t, s.rk+1, case when m.gt is null then s.taken else list_append(s.taken, m.gt) end, m.gt
  from states s left join lateral (select first(p.gt_id order by p.iou desc, p.gt_id desc) as gt from pairs p where p.image_id=s.image_id
     and p.class_id=s.class_id and p.rk=s.rk+1 and p.iou >= s.t and not list_contains(s.taken, p.gt_id)) m on true
  where s.rk < (select max(x.rk) from pairs x where x.image_id=s.image_id and x.class_id=s.class_id))
select pr.image_id, pr.class_id, pr.det_id, coalesce(max(case when t=0.5 then (hit is not null)::int end), 0) as tp50,
  coalesce(max(case when t=0.75 then (hit is not null)::int end), 0) as tp75
from pr left join states s on s.image_id=pr.image_id and s.class_id=pr.class_id and s.rk=pr.rk group by 1, 2, 3"""


@query("J-06", _GREEDY)
def exclusive_matches(t: Tables) -> DataFrame:
    m = M.greedy_matches(t.candidate, t.detections, thresholds=(0.5, 0.75))
    return m.select("image_id", "class_id", "det_id", F.get("tp", F.lit(0)).alias("tp50"), F.get("tp", F.lit(1)).alias("tp75"))
