"""Box and angle expressions over the detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions.geometry import Box
from fieldlens.plans.registry import query, r6, r9
from fieldlens.plans.tables import Tables

KEY = ["image_id", "det_id"]


def _r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _r9(c, name: str):
    return (F.round(c, 9) + F.lit(0.0)).alias(name)


def _sized(t: Tables) -> DataFrame:
    """Detections with the size of their image."""
    return t.detections.join(t.images.select("image_id", "width", "height"), "image_id")


def _pairs(t: Tables) -> DataFrame:
    """Detections next to the box of the same number in the second run."""
    other = t.candidate.select(*KEY, *Box.of().named(suffix="_b"))
    return t.detections.join(other, KEY)


SIZED = "detections d join images i using (image_id)"
PAIRED = """(select a.image_id, a.det_id, a.x1, a.y1, a.x2, a.y2, b.x1 as u1, b.y1 as v1, b.x2 as u2, b.y2 as v2
  from detections a join candidate b using (image_id, det_id))"""
_IW = "greatest(0, least(x2,u2)-greatest(x1,u1))"
_IH = "greatest(0, least(y2,v2)-greatest(y1,v1))"
_UNION = f"((x2-x1)*(y2-y1)+(u2-u1)*(v2-v1)-{_IW}*{_IH})"


@query("G-01 G-02", f"""
select image_id, det_id, cx, cy, w, h, cx-greatest(w,0)/2 as bx1, cy-h/2 as by1, cx+greatest(w,0)/2 as bx2, cy+h/2 as by2
from (select image_id, det_id, (x1+x2)/2 as cx, (y1+y2)/2 as cy, x2-x1-60 as w, y2-y1 as h from detections)""")
def boxes_center_form(t: Tables) -> DataFrame:
    cx, cy, w, h = G.center_from_corners(Box.of())
    d = t.detections.select(*KEY, cx.alias("cx"), cy.alias("cy"), (w - 60).alias("w"), h.alias("h"))
    clamped = G.corners_from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return d.select("*", *clamped.named(prefix="b"))


@query("G-01", """
select image_id, det_id, (x1+x2)/2-(x2-x1-60)/2 as bx1, (x1+x2)/2+(x2-x1-60)/2 as bx2 from detections""")
def boxes_center_form_unclamped(t: Tables) -> DataFrame:
    cx, cy, w, h = G.center_from_corners(Box.of())
    b = G.corners_from_center(cx, cy, w - 60, h, clamp=False)
    return t.detections.select(*KEY, b.x1.alias("bx1"), b.x2.alias("bx2"))


@query("G-03", "select image_id, det_id, x1 as x, y1 as y, x2-x1 as w, y2-y1 as h, x1+(x2-x1) as bx2, y1+(y2-y1) as by2 from detections")
def boxes_corner_size(t: Tables) -> DataFrame:
    x, y, w, h = G.corner_size(Box.of())
    back = G.corners_from_size(x, y, w, h)
    return t.detections.select(*KEY, x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), back.x2.alias("bx2"), back.y2.alias("by2"))


@query("G-04", f"""
select image_id, det_id, {r9('x1/width')} as nx1, {r9('y1/height')} as ny1, {r9('x2/width')} as nx2, {r9('y2/height')} as ny2,
  {r9('x2/width*width')} as px2, {r9('y2/height*height')} as py2 from {SIZED}""")
def boxes_normalised(t: Tables) -> DataFrame:
    n = G.normalised(Box.of(), F.col("width"), F.col("height"))
    p = G.scaled(n, F.col("width"), F.col("height"))
    return _sized(t).select(*KEY, *[_r9(c, f"n{k}") for k, c in zip(Box._fields, n)], _r9(p.x2, "px2"), _r9(p.y2, "py2"))


@query("G-05 P-07", """
select * from (select image_id, det_id, greatest(0, least(width/2, x1)) as x1, greatest(0, least(height/2, y1)) as y1,
  greatest(0, least(width/2, x2)) as x2, greatest(0, least(height/2, y2)) as y2
  from detections d join images i using (image_id)) where x2 > x1 and y2 > y1""")
def boxes_clipped_to_image(t: Tables) -> DataFrame:
    b = G.clipped(Box.of(), F.col("width") / 2, F.col("height") / 2)
    return _sized(t).select(*KEY, *b.named()).filter(G.is_proper(Box.of()))


@query("G-06", f"""
select image_id, det_id, x, y, w, h, w*h as area from (
 select image_id, det_id, x, y, greatest(1, least(bw, width-x)) as w, greatest(1, least(bh, height-y)) as h from (
  select image_id, det_id, width, height, 3*(x2-x1) as bw, 3*(y2-y1) as bh,
   greatest(0, least(2*x1-200, cast(width-1 as double))) as x, greatest(0, least(2*y1-150, cast(height-1 as double))) as y from {SIZED}))""")
def boxes_annotation_clamp(t: Tables) -> DataFrame:
    b = Box.of()
    a = G.annotation_box(b.x1 * 2 - 200, b.y1 * 2 - 150, b.width * 3, b.height * 3, F.col("width"), F.col("height"))
    return _sized(t).select(*KEY, *[c.alias(k) for k, c in a.items()])


@query("G-07", f"""
select image_id, det_id, (x2-x1)*(y2-y1) as area_a, {_IW}*{_IH} as inter, {_UNION} as uni,
  {r6(f'case when {_UNION}=0 then null else {_IW}*{_IH}/{_UNION} end')} as iou_ratio,
  {r6(f'case when least(x2,u2)<greatest(x1,u1) or least(y2,v2)<greatest(y1,v1) or {_UNION}<=0 then 0 else {_IW}*{_IH}/{_UNION} end')} as iou_zero,
  {r6(f'case when least(x2,u2)<=greatest(x1,u1) or least(y2,v2)<=greatest(y1,v1) or {_UNION}<=0 then 0 else {_IW}*{_IH}/{_UNION} end')} as iou_strict
from {PAIRED}""")
def box_overlap(t: Tables) -> DataFrame:
    a, b = Box.of(), Box.of(suffix="_b")
    return _pairs(t).select(
        *KEY, G.area(a).alias("area_a"), G.intersection(a, b).alias("inter"), G.union(a, b).alias("uni"),
        *[_r6(G.iou(a, b, k), f"iou_{k}") for k in ("ratio", "zero", "strict")],
    )


@query("G-08", f"""
select image_id, det_id, {r6(f'{_IW}*{_IH}/{_UNION} - (hull-{_UNION})/hull')} as giou from (
 select *, (greatest(x2,u2)-least(x1,u1))*(greatest(y2,v2)-least(y1,v1)) as hull from {PAIRED})""")
def box_generalized_iou(t: Tables) -> DataFrame:
    return _pairs(t).select(*KEY, _r6(G.generalized_iou(Box.of(), Box.of(suffix="_b")), "giou"))


@query("G-09", f"""
with a as (select image_id, det_id, width w, height h, cast(trunc(greatest(0,x1)) as int) x1, cast(trunc(greatest(0,y1)) as int) y1,
  cast(trunc(least(width,x2)) as int) x2, cast(trunc(least(height,y2)) as int) y2 from {SIZED}),
b as (select *, cast(trunc((x2-x1)*cast(0.1 as double)) as int) px, cast(trunc((y2-y1)*cast(0.1 as double)) as int) py from a),
c as (select image_id, det_id, w, h, greatest(0,x1-px) x1, greatest(0,y1-py) y1, least(w,x2+px) x2, least(h,y2+py) y2 from b),
d as (select *, (x1+x2)//2 cx, (y1+y2)//2 cy, greatest(x2-x1,y2-y1)//2 hs from c),
e as (select image_id, det_id, w, h, greatest(0,cx-hs) x1, greatest(0,cy-hs) y1, least(w,cx+hs) x2, least(h,cy+hs) y2 from d),
f as (select *, greatest(0,(y2-y1)-(x2-x1))//2 gx, greatest(0,(x2-x1)-(y2-y1))//2 gy from e)
select image_id, det_id, greatest(0,x1-gx) as crop_x1, greatest(0,y1-gy) as crop_y1, least(w,x2+gx) as crop_x2, least(h,y2+gy) as crop_y2 from f""")
def square_crop_windows(t: Tables) -> DataFrame:
    d = G.square_crop(_sized(t), Box.of(), "width", "height", padding=0.1)
    return d.select(*KEY, "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query("G-10 G-11", f"""
select image_id, det_id, {r6('least(1, greatest(0, least(trunc(least(width,x2))-trunc(x1), trunc(least(height,y2))-trunc(y1))/96))')} as size_prior,
  {r6('(x2-x1)/width*20*((y2-y1)/height*20)')} as cells,
  {r6('least(1, greatest(0, (x2-x1)/width*20*((y2-y1)/height*20)/4))')} as coverage_prior from {SIZED}""")
def box_priors(t: Tables) -> DataFrame:
    b, w, h = Box.of(), F.col("width"), F.col("height")
    cells = G.cells_covered(b, w, h)
    return _sized(t).select(*KEY, _r6(G.size_prior(b, w, h), "size_prior"), _r6(cells, "cells"), _r6(G.coverage_prior(cells), "coverage_prior"))


@query("G-12 G-14", f"""
select image_id, det_id, {r6('atan2(sin(angle), cos(angle))')} as decoded,
  {r6('(3*angle+pi()) - 2*pi()*floor((3*angle+pi())/(2*pi())) - pi()')} as wrapped from detections""")
def angles_wrapped(t: Tables) -> DataFrame:
    a = F.col("angle")
    return t.detections.select(*KEY, _r6(G.angle_of(F.cos(a), F.sin(a)), "decoded"), _r6(G.wrap_angle(3 * a), "wrapped"))


@query("G-13", f"""
select a.image_id, a.part_id, case when a.x=b.x and a.y=b.y then null else {r6('atan2(b.y-a.y, b.x-a.x)')} end as theta
from parts a join parts b on a.image_id=b.image_id and b.part_id=a.part_id+1""")
def part_to_part_orientation(t: Tables) -> DataFrame:
    nxt = t.parts.select("image_id", (F.col("part_id") - 1).alias("part_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    theta = G.orientation(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return t.parts.join(nxt, ["image_id", "part_id"]).select("image_id", "part_id", _r6(theta, "theta"))


def _wrap_sql(e: str) -> str:
    return f"(({e})+pi()) - 2*pi()*floor((({e})+pi())/(2*pi())) - pi()"


_TURN = "atan2(1.5*sin(angle), 0.5*cos(angle))"


@query("G-15", f"""
select image_id, det_id, {r6(_wrap_sql(_TURN))} as scaled, {r6(_wrap_sql(f'pi()-{_TURN}'))} as flipped_h,
  {r6(_wrap_sql(f'-({_TURN})'))} as flipped_v, {r6(_wrap_sql(f'-(pi()-{_TURN})+cast(0.3 as double)'))} as turned from detections""")
def angles_after_augmentation(t: Tables) -> DataFrame:
    a = F.col("angle")
    return t.detections.select(
        *KEY, _r6(G.moved_angle(a, 0.5, 1.5), "scaled"), _r6(G.moved_angle(a, 0.5, 1.5, hflip=True), "flipped_h"),
        _r6(G.moved_angle(a, 0.5, 1.5, vflip=True), "flipped_v"),
        _r6(G.moved_angle(a, 0.5, 1.5, hflip=True, vflip=True, rotation=0.3), "turned"),
    )


@query("G-16", f"select image_id, det_id, width-x2 as x1, y1, width-x1 as x2, y2 from {SIZED}")
def boxes_flipped(t: Tables) -> DataFrame:
    return _sized(t).select(*KEY, *G.hflipped(Box.of(), F.col("width")).named())


@query("G-17 P-07", """
select image_id, det_id, x1, y1, x2, y2, (x2-x1)*(y2-y1) as area from (
 select image_id, det_id, greatest(0,least(200,x1-150)) as x1, greatest(0,least(150,y1-100)) as y1,
  greatest(0,least(200,x2-150)) as x2, greatest(0,least(150,y2-100)) as y2 from detections) where x2>x1 and y2>y1""")
def boxes_cropped(t: Tables) -> DataFrame:
    b = G.cropped(Box.of(), F.lit(150), F.lit(100), F.lit(200), F.lit(150))
    return t.detections.select(*KEY, *b.named()).filter(G.is_proper(Box.of())).select("*", G.area(Box.of()).alias("area"))


@query("G-18", f"""
with s as (select image_id, width w, height h, case when greatest(width,height)/least(width,height)*800 > 1000
   then cast(round_even(1000.0*least(width,height)/greatest(width,height), 0) as int) else 800 end as size from images),
n as (select image_id, w, h, case when least(w,h)=size then w when w<h then size else cast(trunc(size*w/h) as int) end as nw,
   case when least(w,h)=size then h when w<h then cast(trunc(size*h/w) as int) else size end as nh from s)
select image_id, det_id, nw as new_width, nh as new_height, {r9('x1*(nw/w)')} as x1, {r9('y1*(nh/h)')} as y1, {r9('x2*(nw/w)')} as x2,
  {r9('y2*(nh/h)')} as y2, {r9('(x2-x1)*(y2-y1)*((nw/w)*(nh/h))')} as area,
  {r9(_wrap_sql('atan2(nh/h*sin(angle), nw/w*cos(angle))'))} as angle
from detections join n using (image_id)""")
def boxes_resized(t: Tables) -> DataFrame:
    w, h, b = F.col("width"), F.col("height"), Box.of()
    nw, nh = G.resize_target(w, h, 800, max_size=1000)
    sx, sy = F.col("new_width") / w, F.col("new_height") / h
    return _sized(t).withColumns({"new_width": nw, "new_height": nh}).select(
        *KEY, "new_width", "new_height", *[_r9(c, n) for n, c in zip(Box._fields, G.scaled(b, sx, sy))],
        _r9(G.area(b) * (sx * sy), "area"), _r9(G.moved_angle(F.col("angle"), sx, sy), "angle"),
    )


@query("G-18", f"""
select image_id, det_id, {r9('x1*(512/width)')} as x1, {r9('y1*(512/height)')} as y1, {r9('x2*(512/width)')} as x2, {r9('y2*(512/height)')} as y2
from {SIZED}""")
def boxes_resized_square(t: Tables) -> DataFrame:
    b = G.scaled(Box.of(), F.lit(512.0) / F.col("width"), F.lit(512.0) / F.col("height"))
    return _sized(t).select(*KEY, *[_r9(c, n) for n, c in zip(Box._fields, b)])


@query("G-19", f"""
select image_id, det_id, x1+(1001-width)//2 as x1, y1+(701-height)//2 as y1, x2+(1001-width)//2 as x2, y2+(701-height)//2 as y2,
  x1+1001-width as lt_x1, y1+701-height as lt_y1, cast(round_even((width-225)/2, 0) as int) as crop_left,
  cast(round_even((height-225)/2, 0) as int) as crop_top from {SIZED}""")
def boxes_padded(t: Tables) -> DataFrame:
    w, h, b = F.col("width"), F.col("height"), Box.of()
    mid = G.shifted(b, *G.pad_offsets(w, h, F.lit(1001), F.lit(701), "center"))
    corner = G.shifted(b, *G.pad_offsets(w, h, F.lit(1001), F.lit(701), "left_top"))
    left, top = G.center_crop_origin(w, h, 225, 225)
    return _sized(t).select(*KEY, *mid.named(), corner.x1.alias("lt_x1"), corner.y1.alias("lt_y1"), left.alias("crop_left"), top.alias("crop_top"))


@query("G-20", f"""
with l as (select *, least(256/width, 256/height) as s from {SIZED}),
o as (select *, (256-cast(trunc(width*s) as int))//2 as ox, (256-cast(trunc(height*s) as int))//2 as oy from l)
select image_id, det_id, {r6('x1*s+ox')} as lx, {r6('y1*s+oy')} as ly,
  greatest(0, least(width-1, cast(trunc((cast(det_id*20 as double)-ox)/s) as int))) as px,
  greatest(0, least(height-1, cast(trunc((cast(det_id*15 as double)-oy)/s) as int))) as py from o""")
def letterbox_points(t: Tables) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    lb = G.letterbox(w, h)
    lx, ly = G.into_letterbox(F.col("x1"), F.col("y1"), lb)
    d = F.col("det_id").cast("double")
    px, py = G.out_of_letterbox(d * 20, d * 15, lb, w, h)
    return _sized(t).select(*KEY, _r6(lx, "lx"), _r6(ly, "ly"), px.alias("px"), py.alias("py"))


@query("G-21 F-05", """
select image_id, cast(b as int) as block_no,
  case when b=0 then 0 else width*((b-1)%3)/3 end as x1, case when b=0 then 0 else height*((b-1)//3)/3 end as y1,
  case when b=0 then width else width*((b-1)%3+1)/3 end as x2, case when b=0 then height else height*((b-1)//3+1)/3 end as y2
from images, (select unnest(range(10)) as b)""")
def block_grid_boxes(t: Tables) -> DataFrame:
    return G.block_boxes(t.images.select("image_id", "width", "height"), "width", "height", 3, whole_first=True).drop("width", "height")


@query("G-22", f"""
select image_id, det_id, {r9('(x1/width+x2/width)/2')} as cx, {r9('(y1/height+y2/height)/2')} as cy, {r9('x2/width-x1/width')} as w,
  {r9('y2/height-y1/height')} as h from {SIZED}""")
def boxes_unit_center(t: Tables) -> DataFrame:
    cols = G.unit_center_box(Box.of(), F.col("width"), F.col("height"))
    return _sized(t).select(*KEY, *[_r9(c, n) for n, c in zip(("cx", "cy", "w", "h"), cols)])
