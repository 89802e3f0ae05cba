"""Annotation assembly, splits, training targets, sidecar metadata, paths and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators import dataset as D
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables
from fieldlens.sources import annotations as A
from fieldlens.sources import sidecar as S

C = F.col


def _r(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


_GROUPS = """pg as (select * from (values (2,'head'),(5,'head'),(6,'head'),(7,'head'),(10,'head'),(11,'head'),(15,'head'),(7,'eye'),(11,'eye'),(2,'beak'),(5,'crown'),(14,'tail')) g(part_id, part_group)),
ext as (select image_id, part_group, greatest(0, min(x)-10) as x, greatest(0, min(y)-10) as y, max(x)-greatest(0, min(x)-10)+20 as w, max(y)-greatest(0, min(y)-10)+20 as h, avg(x) as cx, avg(y) as cy
  from parts join pg using (part_id) where visible <> 0 group by 1, 2)"""


@query("A-03 A-04 P-08", f"with {_GROUPS} select image_id, part_group, x, y, w, h, {r6('cx')} as cx, {r6('cy')} as cy from ext")
def part_group_extents(t: Tables) -> DataFrame:
    e = D.group_extents(t.parts)
    return e.select("image_id", "part_group", "x", "y", "w", "h", _r(C("cx"), "cx"), _r(C("cy"), "cy"))


_ORIENT = """ori as (select image_id, case when (b.cx <> a.cx or b.cy <> a.cy) then atan2(b.cy-a.cy, b.cx-a.cx) end as theta, 0 as category_id from ext a join ext b using (image_id) where a.part_group='crown' and b.part_group='tail'
 union all select image_id, case when (b.cx <> a.cx or b.cy <> a.cy) then atan2(b.cy-a.cy, b.cx-a.cx) end, 1 from ext a join ext b using (image_id) where a.part_group='eye' and b.part_group='beak')"""


@query("G-13 A-04", f"""
with {_GROUPS}, {_ORIENT} select image_id, {r6('max(theta) filter (category_id=0)')} as bird_orient, {r6('max(theta) filter (category_id=1)')} as head_orient
from (select distinct image_id from ext) left join ori using (image_id) group by 1""")
def part_group_orientations(t: Tables) -> DataFrame:
    o = D.group_orientations(D.group_extents(t.parts))
    return o.select("image_id", _r(C("bird_orient"), "bird_orient"), _r(C("head_orient"), "head_orient"))


_ANN = f"""{_GROUPS}, {_ORIENT},
bx as (select image_id, 0 as category_id, min(x1)*1.5 as x, min(y1)*1.5 as y, (max(x2)-min(x1))*3 as w, (max(y2)-min(y1))*3 as h from detections group by 1
  union all select image_id, case part_group when 'head' then 1 when 'eye' then 2 else 3 end, x, y, w, h from ext where part_group in ('head','eye','beak')),
c as (select image_id, category_id, greatest(0, least(x, width-1)) as x, greatest(0, least(y, height-1)) as y, w, h, width, height from bx join images using (image_id)),
ann as (select image_id, category_id, x, y, greatest(1, least(w, width-x)) as w, greatest(1, least(h, height-y)) as h, theta as orient from c left join ori using (image_id, category_id))"""


def _boxes(t: Tables) -> DataFrame:
    """One object box per image: the hull of its detections, enlarged."""
    left, top = F.min("x1"), F.min("y1")
    return t.boxes.groupBy("image_id").agg(
        (left * 1.5).alias("x"), (top * 1.5).alias("y"), ((F.max("x2") - left) * 3).alias("w"), ((F.max("y2") - top) * 3).alias("h"))


@query("D-01 J-01 A-03 A-04 G-06 G-13 W-09", f"""
with {_ANN} select row_number() over (order by image_id, category_id) as id, image_id, category_id, x, y, w, h, w*h as area, {r6('orient')} as orient from ann""")
def parts_to_annotations(t: Tables) -> DataFrame:
    a = D.parts_to_annotations(t.images.select("image_id", "width", "height"), _boxes(t), t.parts)
    return a.select("id", "image_id", "category_id", "x", "y", "w", "h", "area", _r(C("orient"), "orient"))


def _split(t: Tables) -> DataFrame:
    return t.images.select("image_id", "path", "width", "height", F.when(C("image_id") % 5 < 4, "train").otherwise("test").alias("split"))


@query("A-29", """
select case when i.image_id%5 < 4 then 'train' else 'test' end as split, count(distinct i.image_id) as n_images, count(det_id) as n_annotations,
 count(distinct case when det_id is not null then class_id end) as n_categories from images i left join detections d on d.image_id=i.image_id group by 1""")
def dataset_summary(t: Tables) -> DataFrame:
    return D.dataset_summary(_split(t), t.boxes.select("image_id", C("class_id").alias("category_id")))


_HALVES = """h as (select image_id, path, case when row_number() over (order by md5(concat(cast(image_id as varchar), ':7')), image_id) <= (select count(*) from images)//2 then 'valid' else 'test' end as split from images)"""


@query("D-02 O-03 J-08", f"""
with {_HALVES} select d.image_id, det_id, split, concat('/mnt/set', substr(path, 6)) as path from detections d join h using (image_id)""")
def holdout_annotations(t: Tables) -> DataFrame:
    images, annotations = D.split_holdout(t.images.select("image_id", "path"), t.detections.select("image_id", "det_id"), 7, ("/data", "/mnt/set"))
    return annotations.join(images.select("image_id", "path"), "image_id").select("image_id", "det_id", "split", "path")


def _annotated(t: Tables) -> DataFrame:
    """Detections as annotations: some crowds, some without angle, boxes doubled so that clipping matters."""
    return t.detections.select(
        "image_id", "det_id", C("class_id").alias("category_id"), (C("x1") * 1.8).alias("x"), (C("y1") * 1.8).alias("y"), ((C("x2") - C("x1")) * 1.8).alias("w"), ((C("y2") - C("y1")) * 1.8).alias("h"),
        F.expr("case when det_id%5=0 then 1 when det_id%5=1 then null else 0 end").alias("iscrowd"), F.expr("case when det_id%2=0 then angle end").alias("orient"))


@query("D-03 P-06 G-05 P-07", f"""
select image_id, det_id, category_id, {r6('x1')} as x1, {r6('y1')} as y1, {r6('x2')} as x2, {r6('y2')} as y2, {r6('orient')} as orient from (
 select image_id, det_id, class_id as category_id, greatest(0,least(width,x1*1.8::double)) as x1, greatest(0,least(height,y1*1.8::double)) as y1, greatest(0,least(width,x1*1.8::double+(x2-x1)*1.8::double)) as x2,
 greatest(0,least(height,y1*1.8::double+(y2-y1)*1.8::double)) as y2, case when det_id%2=0 then angle end as orient from detections join images using (image_id) where det_id%5<>0) where x2>x1 and y2>y1""")
def training_targets(t: Tables) -> DataFrame:
    d = D.training_targets(_annotated(t), t.images)
    return d.select("image_id", "det_id", "category_id", *[_r(C(c), c) for c in ("x1", "y1", "x2", "y2", "orient")])


@query("D-04 O-04 G-15 G-16 G-17 G-18")
def augmented_targets(t: Tables) -> DataFrame:
    """Two epochs of seeded augmentation (choices are hashes, checked in the tests)."""
    targets = D.training_targets(_annotated(t), t.images).withColumn("area", (C("x2") - C("x1")) * (C("y2") - C("y1")))
    return D.augment_targets(targets, epochs=2, seed=11)


@query("S-13", """
select doc_id as image_id, doc_id%5=0 as is_valid, r.region, cast((n_chars + r.k*13)%101 as double) as mos, cast(r.k*10 as double) as "left", cast(r.k*10+50 as double) as "right" from documents,
 (values (0,'image'),(1,'patch_1'),(2,'patch_2'),(3,'patch_3')) r(k, region)""")
def mos_regions(t: Tables) -> DataFrame:
    names = ("image", "patch_1", "patch_2", "patch_3")
    wide = t.raw("documents").select(
        C("doc_id").cast("string").alias("name_image"), (C("doc_id") % 5 == 0).alias("is_valid"),
        *[((C("n_chars") + k * 13) % 101).cast("double").alias(f"mos_{n}") for k, n in enumerate(names)],
        *[F.lit(float(v)).alias(f"{side}_{n}") for k, n in enumerate(names) for side, v in (("left", k * 10), ("top", k * 10), ("right", k * 10 + 50), ("bottom", k * 10 + 50))])
    return A.mos_regions(wide).select(C("name_image").cast("bigint").alias("image_id"), "is_valid", "region", "mos", "left", "right")


# ---- sidecar metadata ----------------------------------------------------------------------------------------------

@query("S-09 T-05", """
with e as (select image_id, concat('d', cast(width as varchar)) as detect, case when image_id%2=0 then concat('c', cast(height as varchar)) end as cutout, cast(null as varchar) as quality from images where image_id%3<>0),
u as (select image_id, max(case when det_id=2 then concat('new', cast(class_id as varchar)) end) as detect, cast(null as varchar) as cutout, concat('q', cast(count(*) as varchar)) as quality from detections group by 1)
select image_id, coalesce(u.detect, e.detect) as detect, coalesce(u.cutout, e.cutout) as cutout, coalesce(u.quality, e.quality) as quality from e full outer join u using (image_id)""")
def metadata_upsert(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    existing = t.images.filter("image_id%3<>0").select(
        "image_id", F.concat(F.lit("d"), C("width").cast("string")).alias("detect"), F.when(C("image_id") % 2 == 0, F.concat(F.lit("c"), C("height").cast("string"))).alias("cutout"), none.alias("quality"))
    updates = t.detections.groupBy("image_id").agg(
        F.max(F.when(C("det_id") == 2, F.concat(F.lit("new"), C("class_id").cast("string")))).alias("detect"), F.max(none).alias("cutout"),
        F.concat(F.lit("q"), F.count(F.lit(1)).cast("string")).alias("quality"))
    return S.upsert_sections(existing, updates)


@query("S-10", "select image_id, gy as row_no, gx as col_no, round(v, 2) + 0.0 as v from grid_cells")
def written_grids(t: Tables) -> DataFrame:
    """Grids as written: JSON rows with two decimals, NULL sections left out, read back."""
    doc = S.metadata_json(S.rounded_grid(S.to_rows(C("cells"), 8)).alias("grid"), F.lit(None).cast("string").alias("note"))
    back = t.grids.select("image_id", F.from_json(doc, "grid array<array<double>>, note string").alias("d"))
    rows = back.select("image_id", F.posexplode("d.grid").alias("row_no", "r"))
    return rows.select("image_id", "row_no", F.posexplode("r").alias("col_no", "v")).withColumn("v", C("v") + F.lit(0.0))


_STEM = r"regexp_extract(path, '([^/]*)\.[^./]*$', 1)"


@query("X-12", rf"""
select image_id, {_STEM} as stem, lower(regexp_extract(path, '\.([^./]+)$', 1)) as ext, regexp_extract(path, '^(.*)/', 1) as parent,
 concat(regexp_extract(path, '^(.*)/', 1), '/', case when {_STEM} like '%\_7' escape '\' then {_STEM} else concat({_STEM}, '_7') end, '.png') as output,
 concat(regexp_extract(path, '^(.*)/', 1), '/', {_STEM}, '.sidecar.toml') as metadata,
 case when path like '/data/d1/%' then substr(path, 10) else path end as relative from images""")
def path_parts(t: Tables) -> DataFrame:
    p = C("path")
    return t.images.select(
        "image_id", text.stem(p).alias("stem"), text.extension(p).alias("ext"), text.parent(p).alias("parent"), text.output_path(p, F.lit("7"), F.lit("png")).alias("output"),
        text.metadata_path(p).alias("metadata"), text.relative_to(p, F.lit("/data/d1")).alias("relative"))


@query("X-13", """
select doc_id, md5(text) as md5, sha256(text) as sha256, concat('model-', md5(text), '.onnx') as versioned, doc_id%3 <> 0 as verified from documents""")
def content_digests(t: Tables) -> DataFrame:
    """Digests of whole contents, verified against a manifest with some wrong entries."""
    docs = t.raw("documents").select("doc_id", "text")
    digest = docs.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
    manifest = digest.select("doc_id", F.when(C("doc_id") % 3 == 0, F.lit("0" * 64)).otherwise(C("sha256")).alias("expected"))
    joined = digest.join(manifest, "doc_id", "left")
    return joined.select("doc_id", "md5", "sha256", text.versioned_name(F.lit("model.onnx"), C("md5")).alias("versioned"), (C("expected") == C("sha256")).alias("verified"))


@query("X-15", "select event_id, json_extract_string(props, '$.k') as k, cast(null as varchar) as missing from events")
def nested_values(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", text.nested_value(C("props"), "k").alias("k"), text.nested_value(C("props"), "a.b").alias("missing"))


@query("X-16", """
select event_id, case when event_id%3=0 and event_type='error' then null when event_id%3=0 then concat('KIND=', event_type) when event_type='error' then concat('USER=', cast(user_id as varchar))
 else concat('KIND=', event_type, ',USER=', cast(user_id as varchar)) end as kept from events""")
def kept_environment(t: Tables) -> DataFrame:
    env = F.create_map(F.lit("KIND"), F.when(C("event_type") == "error", F.lit("")).otherwise(C("event_type")),
                       F.lit("USER"), F.when(C("event_id") % 3 == 0, F.lit(None)).otherwise(C("user_id").cast("string")), F.lit("OTHER"), F.lit("x"))
    kept = text.kept_entries(env, ["KIND", "USER"])
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return t.raw("events").select("event_id", shown.alias("kept"))
