"""Decoding, filters, top-k, catalog rules, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators import decode as D
from fieldlens.operators import selection as S
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables
from fieldlens.schemas import CALIBRATION_EXTENSIONS, CLASS_NAMES

_NAME = "case class_id when 0 then 'bird' when 1 then 'head' when 2 then 'eye' when 3 then 'beak' else 'unknown' end"
_TOP10 = """(select * from (select *, row_number() over (partition by image_id order by confidence desc, det_id) as rn
  from detections) where rn <= 10)"""


def _top10(t: Tables, threshold: float) -> DataFrame:
    kept = t.detections.filter(F.col("confidence") >= threshold)
    return S.known_classes(S.top_k(kept, ["image_id"], [F.col("confidence").desc(), F.col("det_id")], 10))


@query("W-01 P-01 P-03 A-01", f"""
select image_id, {_NAME} as class_name, count(*) as n from {_TOP10} where confidence >= 0.5 group by 1, 2""")
def detection_counts(t: Tables) -> DataFrame:
    """Flagship: candidate scores to per-class counts."""
    return D.class_counts(_top10(t, 0.5))


@query("W-01", f"select image_id, det_id, class_id, confidence, cast(rn as int) as rank_no from {_TOP10}")
def topk_per_image(t: Tables) -> DataFrame:
    return S.top_k(t.detections, ["image_id"], [F.col("confidence").desc(), F.col("det_id")], 10, rank="rank_no").select(
        "image_id", "det_id", "class_id", "confidence", "rank_no"
    )


def _raw_outputs(t: Tables) -> DataFrame:
    """Raw detector output per (image, query): 16 queries x 4 classes cut from the 8x8 grids."""
    q = F.sequence(F.lit(0), F.lit(15))
    per_query = t.grids.select("image_id", "cells", F.explode(q).alias("query_id"))
    cell = lambda i: F.get("cells", F.col("query_id") * 4 + i)
    return per_query.select(
        "image_id", "query_id",
        F.array((F.col("query_id") % 4 + 0.5) / 4, (F.floor(F.col("query_id") / 4) + 0.5) / 4,
                F.abs(cell(0)) / 2 + 0.05, F.abs(cell(1)) / 2 + 0.05).alias("box"),
        F.array(*[cell(i) * 8 for i in range(4)]).alias("logits"), F.array(cell(2), cell(3)).alias("orient"),
    )


_DECODED = """
with g as (select image_id, (gy*8+gx)//4 as query_id, max(case when gx%4=0 then v end) as v0, max(case when gx%4=1 then v end) as v1,
   max(case when gx%4=2 then v end) as v2, max(case when gx%4=3 then v end) as v3 from grid_cells group by 1, 2),
p as (select image_id, query_id, class_id, 1/(1+exp(-logit)) as confidence from logits),
r as (select *, row_number() over (partition by image_id order by confidence desc, query_id, class_id) as rn from p),
b as (select r.*, width as iw, height as ih, (query_id%4+0.5)/4 as cx, (query_id//4+0.5)/4 as cy, abs(v0)/2+0.05 as bw, abs(v1)/2+0.05 as bh, v2, v3
  from r join g using (image_id, query_id) join images using (image_id) where rn <= {k} and confidence >= {t})
"""


@query("D-05 X-01 G-12", _DECODED.format(k=10, t=0.5) + f"""
select image_id, cast(rn as int) as det_id, class_id, {_NAME} as class_name, {r6('(cx-bw/2)*iw')} as x1, {r6('(cy-bh/2)*ih')} as y1,
  {r6('(cx+bw/2)*iw')} as x2, {r6('(cy+bh/2)*ih')} as y2, {r6('confidence')} as confidence, {r6('atan2(v3, v2)')} as angle from b""")
def decoded_detections(t: Tables) -> DataFrame:
    d = D.decode_detections(_raw_outputs(t), t.images, k=10, threshold=0.5)
    return d.select("image_id", "det_id", "class_id", "class_name",
                    *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2", "confidence", "angle")])


@query("D-05 P-03", _DECODED.format(k=5, t=0.3) + """
select image_id, cast(rn as int) as det_id, case class_id when 1 then 'bird' when 2 then 'head' else 'eye' end as class_name
from b where class_id > 0""")
def decoded_shifted_classes(t: Tables) -> DataFrame:
    """The older model size numbers classes from 1 and has a background class, which is dropped."""
    return D.decode_detections(_raw_outputs(t), t.images, k=5, threshold=0.3, model_size=384).select("image_id", "det_id", "class_name")


@query("P-02", "select image_id, det_id, confidence from detections where confidence > 0.5")
def confidence_above(t: Tables) -> DataFrame:
    return t.detections.filter(F.col("confidence") > 0.5).select("image_id", "det_id", "confidence")


@query("A-01", f"""
select image_id, count(*) filter ({_NAME}='bird') as n_bird, count(*) filter ({_NAME}='head') as n_head,
  count(*) filter ({_NAME}='eye') as n_eye, count(*) filter ({_NAME}='beak') as n_beak from detections group by 1""")
def detection_counts_wide(t: Tables) -> DataFrame:
    return D.class_counts_wide(S.known_classes(t.boxes), CLASS_NAMES)


@query("W-02", """
select image_id, class_id, det_id, confidence from (select *, row_number() over (partition by image_id, class_id
  order by confidence desc, det_id) as rn from detections) where rn = 1""")
def best_per_class(t: Tables) -> DataFrame:
    return D.best_per_class(t.detections).select("image_id", "class_id", "det_id", "confidence")


@query("P-05", "select image_id, class_id, count(*) as n from detections where class_id in (0, 1) group by 1, 2")
def display_classes(t: Tables) -> DataFrame:
    shown = S.known_classes(t.boxes).filter(F.col("class_name").isin("bird", "head"))
    return shown.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


_STEM = r"regexp_extract(path, '([^/]*)\.[^./]*$', 1)"
_CROPS = f"""
with d as (select *, {_NAME} as class_name from {_TOP10} where confidence >= 0.3),
n as (select d.*, row_number() over (partition by image_id order by confidence desc, det_id) as i,
  count(*) over (partition by image_id, class_id) as total from d)
select image_id, det_id, case when class_name in ('head','eye') then concat(regexp_extract(path, '^(.*)/', 1), '/', {_STEM}, '_crop_', class_name,
   case when total = 1 then '' when total < 10 or i >= 10 then concat('-', cast(i as varchar)) else concat('-0', cast(i as varchar)) end,
   case when lower(path) like '%.png' then '.png' else '.jpg' end) end as crop_path
from n join images using (image_id)"""


@query("P-04 W-10", _CROPS)
def crop_paths(t: Tables) -> DataFrame:
    d = _top10(t, 0.3).join(t.images.select("image_id", "path"), "image_id")
    return S.numbered_crops(d, ["head", "eye"]).select("image_id", "det_id", "crop_path")


@query("P-06", "select image_id, det_id from (select image_id, det_id, case when det_id%4=0 then null when det_id%4=1 then 1 else 0 end as iscrowd from detections) where coalesce(iscrowd,0)=0")
def without_crowds(t: Tables) -> DataFrame:
    flagged = t.detections.withColumn("iscrowd", F.expr("case when det_id%4=0 then null when det_id%4=1 then 1 else 0 end"))
    return flagged.filter(F.coalesce("iscrowd", F.lit(0)) == 0).select("image_id", "det_id")


@query("P-08", """
select p.image_id, p.part_id, g.part_group from parts p join (values (2,'head'),(5,'head'),(6,'head'),(7,'head'),(10,'head'),(11,'head'),(15,'head'),
  (7,'eye'),(11,'eye'),(2,'beak'),(5,'crown'),(14,'tail')) g(part_id, part_group) on p.part_id = g.part_id where visible <> 0""")
def visible_group_parts(t: Tables) -> DataFrame:
    from fieldlens.operators.dataset import visible_parts

    return visible_parts(t.parts).select("image_id", "part_id", "part_group")


@query("P-09", """
select image_id, path from images where image_id in (select image_id from detections where angle > 3) order by image_id limit 20""")
def first_oriented_images(t: Tables) -> DataFrame:
    oriented = t.boxes.filter("angle > 3").select("image_id")
    return t.images.join(oriented, "image_id", "left_semi").select("image_id", "path").orderBy("image_id").limit(20)


_ARTIFACT = "case when n like '%fp16%' then 'FP16' when n like '%dynamic-int8%' then 'Dynamic INT8' when n like '%static-int8%' then 'Static INT8' when n like '%dynamic%' then 'Dynamic' when n like '%static%' then 'Static' when n like '%int8%' then 'INT8' else 'Unknown' end"


@query("P-10 U-01", f"""
select * from (select distinct n as name, {_ARTIFACT} as kind from (select concat('detect-', case p_partkey%8 when 0 then 'fp16' when 1 then 'dynamic-int8'
  when 2 then 'static-int8' when 3 then 'dynamic' when 4 then 'static' when 5 then 'int8' when 6 then 'fp16-int8' else 'base' end, '-', p_type, '.onnx') as n from part))
where kind <> 'Unknown'""")
def artifact_types(t: Tables) -> DataFrame:
    name = F.expr("concat('detect-', case p_partkey%8 when 0 then 'fp16' when 1 then 'dynamic-int8' when 2 then 'static-int8' when 3 then 'dynamic' "
                  "when 4 then 'static' when 5 then 'int8' when 6 then 'fp16-int8' else 'base' end, '-', p_type, '.onnx')")
    files = t.raw("part").select(name.alias("name"))
    marked = [F.contains("name", F.lit(m)) for m in ("dynamic", "static", "int8", "fp16")]
    listed = files.filter(marked[0] | marked[1] | marked[2] | marked[3]).distinct()
    return listed.select("name", text.artifact_type(F.col("name")).alias("kind")).orderBy("name")


@query("P-11", """
select image_id, det_id, 'confidence' as field, confidence as value from detections where not confidence between 0.1 and 0.9
union all select image_id, det_id, 'angle', angle from detections where not angle between -3 and 3""")
def values_out_of_range(t: Tables) -> DataFrame:
    return S.range_violations(t.detections, {"confidence": (0.1, 0.9), "angle": (-3.0, 3.0)}, ["image_id", "det_id"])


@query("P-12 P-13", """
select run_id, class, count(*) as n from metric_log where epoch%7 <> 0 and epoch%11 <> 0 group by 1, 2""")
def finite_metrics(t: Tables) -> DataFrame:
    """Rows whose metric is NaN or infinite are left out of the report."""
    v = F.expr("case when epoch%7=0 then double('NaN') when epoch%11=0 then double('Infinity') else value end")
    return S.finite(t.metric_log.withColumn("value", v), "value").groupBy("run_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("F-01 D-05", f"""
with p as (select image_id, j//4 as query_id, j%4 as class_id, 1/(1+exp(-sum(v*((7*(gy*8+gx)+13*j)%101-50)/25))) as confidence
  from grid_cells, range(24) o(j) group by image_id, j),
r as (select *, row_number() over (partition by image_id order by confidence desc, query_id, class_id) as rn from p)
select image_id, cast(rn as int) as det_id, {_NAME} as class_name, round(confidence, 4) as confidence from r where rn <= 5 and confidence >= 0.5""")
def model_detections(t: Tables) -> DataFrame:
    """A user model run in batches over every image, then decoded. The stand-in model has weights by a formula."""
    from fieldlens.functions import models as U

    raw = U.raw_outputs(t.grids, U.detector_udf(U.linear_detector(6, 4, 64), [64])("cells"), 6, 4)
    return D.decode_detections(raw, t.images, k=5, threshold=0.5).select("image_id", "det_id", "class_name", F.round("confidence", 4).alias("confidence"))


@query("F-03 A-21", "select count(*) as total, count(*) filter (event_type <> 'error') as success, count(*) filter (event_type = 'error') as failed from events")
def captured_failures(t: Tables) -> DataFrame:
    """A function that fails on some rows: those rows stay, with the error text."""
    from pyspark.sql import types as T

    from fieldlens.functions import models as U

    def checked(kind: str) -> int:
        if kind == "error":
            raise ValueError("cannot process")
        return len(kind)

    return U.failure_summary(U.apply_capturing_errors(t.raw("events").select("event_id", "event_type"), "event_type", checked, T.IntegerType()))


# ---- catalog -------------------------------------------------------------------------------------------------------

@query("S-02 T-01", "select image_id, path from images where lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('jpg','jpeg','png','webp','bmp','tiff','tif')")
def supported_images(t: Tables) -> DataFrame:
    return t.images.filter(text.is_supported(F.col("path"))).select("image_id", "path")


@query("S-02 O-02", "select distinct path from images where path not like '%.gif' order by path limit 100")
def calibration_images(t: Tables) -> DataFrame:
    usable = t.images.filter(text.is_supported(F.col("path"), CALIBRATION_EXTENSIONS))
    return usable.select("path").distinct().orderBy("path").limit(100)


@query("S-01 U-02", """
select path, source_type, image_id from (select *, row_number() over (partition by path order by image_id desc) as rn from images) where rn = 1""")
def catalog_last_source(t: Tables) -> DataFrame:
    return S.last_source_wins(t.images.select("path", "source_type", "image_id"), "image_id")


@query("U-02", "select path, min(image_id) as image_id from images group by 1")
def catalog_first_seen(t: Tables) -> DataFrame:
    return S.first_per_key(t.images.select("path", "image_id"), ["path"], [F.col("image_id")])


@query("S-03", """
select image_id, path, case when path like '%.gif' then 'unsupported' when image_id%13=0 then 'missing' end as reason
from images where path like '%.gif' or path not in (select path from images where image_id%13<>0)""".replace("when image_id%13=0 then 'missing'", "else 'missing'"))
def catalog_rejects(t: Tables) -> DataFrame:
    found = t.images.filter("image_id%13<>0")
    _, rejects = S.check_requested(t.images.select("image_id", "path"), found)
    return rejects


@query("A-08", f"""
select stem, count(*) as n_paths, min(path) as first_path, max(path) as last_path from (select distinct path, {_STEM} as stem from images)
group by 1 having count(*) > 1""")
def stem_collisions(t: Tables) -> DataFrame:
    return S.stem_collisions(t.images)


@query("A-08", f"""
with p as (select distinct path, {_STEM} as stem from images)
select stem, path from p where stem in (select stem from p group by 1 having count(*) > 1)""")
def stem_collision_members(t: Tables) -> DataFrame:
    return S.colliding_paths(t.images)


@query("O-01", "select path, count(*) as n from images group by 1")
def catalog_by_path(t: Tables) -> DataFrame:
    return t.images.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy("path")


_FILES = """(select concat('/cache/', case when page_id%5=0 then '.' else '' end, 'm', cast(page_id as varchar),
  case when page_id%7=0 then '.lock' else '.onnx' end) as path, length(html) as length from pages)"""


@query("S-17", f"""
select count(*) as n_files, {r6('sum(length)/1048576')} as total_mb from {_FILES}
where path not like '%/.%' and path not like '%.lock'""")
def artifact_inventory(t: Tables) -> DataFrame:
    files = t.raw("pages").selectExpr(
        "concat('/cache/', case when page_id%5=0 then '.' else '' end, 'm', cast(page_id as string), case when page_id%7=0 then '.lock' else '.onnx' end) as path",
        "length(html) as length")
    return S.inventory(files).select("n_files", F.round("total_mb", 6).alias("total_mb"))


# ---- splits, sets and recency --------------------------------------------------------------------------------------

_HALVES = """(select image_id, case when row_number() over (order by md5(concat(cast(image_id as varchar), ':42')), image_id)
  <= (select count(*) from images)//2 then 'valid' else 'test' end as split from images)"""


@query("O-03", f"select * from {_HALVES}")
def shuffled_halves(t: Tables) -> DataFrame:
    return S.shuffled_halves(t.images.select("image_id"), "image_id", 42)


@query("U-04", f"""
select (select count(*) from (select image_id from {_HALVES} where split='valid' intersect select image_id from {_HALVES} where split='test')) as in_several,
  (select count(*) from images where image_id not in (select image_id from {_HALVES})) as in_none, cast(0 as bigint) as outside""")
def split_disjointness(t: Tables) -> DataFrame:
    halves = S.shuffled_halves(t.images.select("image_id"), "image_id", 42)
    parts = [halves.filter(F.col("split") == s) for s in ("valid", "test")]
    return S.split_check(parts, t.images, "image_id")


@query("O-04", "select image_id, path from images where cast(concat('0x', substr(md5(concat(cast(image_id as varchar), ':7:')), 1, 13)) as bigint) / 4503599627370496.0::double < 0.5")
def sampled_images(t: Tables) -> DataFrame:
    """Sampling operator: repeatable half of the images by a seeded hash."""
    return S.sample_rows(t.images.select("image_id", "path"), "image_id", 0.5, seed=7)


@query("U-03", """
select shard, count(*) as n, count(distinct image_id) as n_images, sum(confidence) as total from (
 select 'baseline' as shard, image_id, cast(round(confidence*1000) as bigint) as confidence from detections
 union all select 'candidate', image_id, cast(round(confidence*1000) as bigint) from candidate) group by 1""".replace("sum(confidence)", "cast(sum(confidence) as bigint)"))
def merged_shards(t: Tables) -> DataFrame:
    cols = ["image_id", F.round(F.col("confidence") * 1000).cast("bigint").alias("confidence")]
    both = t.detections.select(F.lit("baseline").alias("shard"), *cols).unionByName(
        t.candidate.select(F.lit("candidate").alias("shard"), *cols))
    per_image = both.groupBy("shard", "image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"))
    return per_image.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_images"), F.sum("total").alias("total"))


@query("W-11", """
select path, event_id, kind from (select *, row_number() over (partition by path order by ts desc, event_id desc) as rn from run_events)
where rn = 1 order by ts desc, event_id desc limit 10""")
def most_recent_items(t: Tables) -> DataFrame:
    return S.most_recent(t.run_events.select("path", "ts", "event_id", "kind"), "path", "ts", "event_id").select("path", "event_id", "kind")
