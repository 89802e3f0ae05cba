"""Quality layers, triage, masks, pixels and keypoints over the 8x8 grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions import grids as R
from fieldlens.functions import kernels as K
from fieldlens.functions import tensors as X
from fieldlens.functions.geometry import Box
from fieldlens.functions.table_functions import register_table_functions
from fieldlens.operators import pose as P
from fieldlens.operators import quality as Q
from fieldlens.operators import states as S
from fieldlens.plans.registry import query, r6
from fieldlens.plans.tables import Tables
from fieldlens.schemas import CHANNEL_MEAN, CHANNEL_STD, QualityParams, TriageParams

C = F.col
SWEEP = [QualityParams(tau=0.005 * (i % 5 + 1), alpha=0.4 + 0.1 * (i // 5), beta=1.0 + 0.05 * i) for i in range(20)]


def _r(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def _cells(df: DataFrame, array: str, name: str = "v") -> DataFrame:
    """One row per cell, for comparison with the exploded SQL form."""
    return df.select("image_id", F.posexplode(array).alias("pos", name))


# ---- blur layers and scores ----------------------------------------------------------------------------------------

def _raw(t: Tables) -> DataFrame:
    full, half = F.transform("cells", lambda v: v * v), F.transform("cells", lambda v: v * v / 2 + 0.001)
    d = t.grids.select("image_id", full.alias("energy_full"), half.alias("energy_half"), (40 + C("image_id") % 60).cast("double").alias("global_score"))
    median, ratio = Q.scale_ratio(C("energy_full"), C("energy_half"))
    return d.withColumns({"median_full": median, "ratio": ratio})


_RAW = """raw as (select image_id, gy, gx, v*v as f, v*v/2+0.001 as h, cast(40+image_id%60 as double) as global_score from grid_cells),
med as (select image_id, greatest(list_sort(list(f))[33], 1e-12) as mf, least(0.80, greatest(0.05, list_sort(list(h))[33]/greatest(list_sort(list(f))[33], 1e-12))) as ratio
  from raw group by 1)"""


@query("A-06", f"with {_RAW} select image_id, {r6('mf')} as median_full, {r6('ratio')} as ratio from med")
def energy_medians(t: Tables) -> DataFrame:
    return _raw(t).select("image_id", _r(C("median_full"), "median_full"), _r(C("ratio"), "ratio"))


_PARAMS = "p as (select i as param_no, 0.005*(i%5+1)::double as tau, 0.4::double+0.1::double*(i//5) as alpha, 1.0+0.05::double*i as beta from (select unnest(range(20)) as i))"
_PROB = """pr as (select image_id, gy, gx, param_no, alpha, global_score,
  1-(1-least(1,pow(greatest(tau,1e-12)/(f+greatest(tau,1e-12)),beta)))*(1-least(1,pow(greatest(tau*ratio*1.25,1e-12)/(h+greatest(tau*ratio*1.25,1e-12)),beta))) as pb
  from raw join med using (image_id), p)"""


@query("D-06 J-11 X-04 X-05 X-06 A-07", f"""
with {_RAW}, {_PARAMS}, {_PROB}
select image_id, cast(param_no as int) as param_no, {r6('avg(pb)')} as blur_score, {r6('avg(greatest(0.2, least(1, 1-alpha*pb)))')} as mean_weight,
  {r6('max(global_score)*greatest(0.2, least(1, 1-max(alpha)*avg(pb)))')} as final_score from pr group by 1, 2""")
def quality_sweep(t: Tables) -> DataFrame:
    """Every image under twenty parameter sets."""
    s = Q.score_quality(_raw(t), SWEEP)
    return s.select("image_id", "param_no", _r(C("blur_score"), "blur_score"), _r(R.array_mean(C("blur_weights")), "mean_weight"), _r(C("final_score"), "final_score"))


@query("X-04 X-05 X-06", f"""
with {_RAW}, p as (select 0 as param_no, 0.02::double as tau, 0.7::double as alpha, 1.2::double as beta), {_PROB}
select image_id, cast(gy*8+gx as int) as pos, {r6('pb')} as blur_probability, {r6('greatest(0.2, least(1, 1-alpha*pb))')} as blur_weight from pr""")
def blur_grids(t: Tables) -> DataFrame:
    s = Q.scored_cells(_raw(t), QualityParams())
    both = s.select("image_id", F.posexplode(F.arrays_zip("blur_probability", "blur_weights")).alias("pos", "z"))
    return both.select("image_id", "pos", _r(C("z.blur_probability"), "blur_probability"), _r(C("z.blur_weights"), "blur_weight"))


@query("A-05 F-04", f"""
select image_id, cast((3*(gy+1)-1)//8 as int) as ty, cast((3*(gx+1)-1)//8 as int) as tx, {r6('avg(v*v)')} as energy from grid_cells group by 1, 2, 3""")
def tile_means(t: Tables) -> DataFrame:
    tiled = t.grid_cells.groupBy("image_id", R.tile_of(C("gy"), 8, 3).alias("ty"), R.tile_of(C("gx"), 8, 3).alias("tx"))
    return tiled.agg(_r(F.avg(C("v") * C("v")), "energy"))


@query("F-04 A-05", f"""
select image_id, cast((3*(gy+1)-1)//8 as int) as ty, cast((3*(gx+1)-1)//8 as int) as tx, {r6('avg(v*v)')} as energy from grid_cells group by 1, 2, 3""")
def merged_tile_means(t: Tables) -> DataFrame:
    """Tile means of each image from states made for each row of its grid and merged."""
    tile = R.tile_of(C("gy"), 8, 3) * 3 + R.tile_of(C("gx"), 8, 3)
    rows = t.grid_cells.groupBy("image_id", "gy").agg(S.mean_state(C("v") * C("v"), tile, 9).alias("state"))
    means = rows.groupBy("image_id").agg(S.state_means(S.merged_state("state", 18, "double"), 9).alias("m"))
    each = means.select("image_id", F.posexplode("m").alias("k", "energy"))
    return each.select("image_id", F.floor(C("k") / 3).cast("int").alias("ty"), (C("k") % 3).alias("tx"), _r(C("energy"), "energy"))


@query("A-09", f"""
select image_id, {r6('min(v)')} as min, {r6('max(v)')} as max, {r6('avg(v)')} as mean, {r6('list_sort(list(v))[33]')} as median from grid_cells group by 1""")
def grid_statistics(t: Tables) -> DataFrame:
    return t.grids.select("image_id", *[_r(c, n) for n, c in R.grid_statistics(C("cells")).items()])


@query("A-10", f"""
select image_id, {r6('sum(abs(base-quant))')} as l1, {r6('max(abs(base-quant))')} as linf, count(*) filter (quant>base) as n_greater from model_outputs group by 1""")
def grid_differences(t: Tables) -> DataFrame:
    quant = F.transform("cells", lambda v: F.round(v * 127, 0) / 127)
    d = R.grid_difference(C("cells"), quant)
    return t.grids.select("image_id", _r(d["l1"], "l1"), _r(d["linf"], "linf"), d["n_greater"].alias("n_greater"))


@query("A-11", f"""
with s as (select image_id, list_sort(list(v)) as s, min(v) as lo, max(v) as hi from grid_cells group by 1)
select g.image_id, cast(gy*8+gx as int) as pos, {r6('least(1, greatest(0, (v-s[2])/(s[63]-s[2])))')} as robust, {r6('(v-lo)/(hi-lo)')} as plain
from grid_cells g join s using (image_id)""")
def unit_grids(t: Tables) -> DataFrame:
    a = C("cells")
    both = t.grids.select("image_id", R.robust_unit_range(a).alias("robust"), R.unit_range(a, F.array_min(a), F.array_max(a)).alias("plain"))
    z = both.select("image_id", F.posexplode(F.arrays_zip("robust", "plain")).alias("pos", "z"))
    return z.select("image_id", "pos", _r(C("z.robust"), "robust"), _r(C("z.plain"), "plain"))


@query("A-11", f"""
with r as (select class_id, confidence, row_number() over (partition by class_id order by confidence) - 1 as i, count(*) over (partition by class_id) as n from detections)
select class_id, max(confidence) filter (i=round((n-1)*0.02::double)) as p02, max(confidence) filter (i=round((n-1)*0.98::double)) as p98 from r group by 1""")
def corpus_percentiles(t: Tables) -> DataFrame:
    """Exact nearest-rank percentiles over the whole corpus, without one sorted group per class."""
    from fieldlens.operators.running import order_statistics

    at = lambda p: F.round((C("size") - 1) * F.lit(p), 0).cast("bigint") + 1
    return order_statistics(t.boxes, ["class_id"], "confidence", {"p02": at(0.02), "p98": at(0.98)})


# ---- regions of interest and triage --------------------------------------------------------------------------------

_SAMPLES = """s as (select image_id, det_id, width, height, u, v from (
  select d.image_id, det_id, width, height, least(7.999, greatest(0, (greatest(x1,0)+(sx+0.5)/8*greatest(1,least(x2,width)-greatest(x1,0)))/width*8)) as u,
   least(7.999, greatest(0, (greatest(y1,0)+(sy+0.5)/8*greatest(1,least(y2,height)-greatest(y1,0)))/height*8)) as v
  from detections d join images i using (image_id), (select unnest(range(8)) as sx), (select unnest(range(8)) as sy) where d.image_id in (select image_id from grid_cells))),
f as (select *, cast(floor(u) as int) as x0, cast(floor(v) as int) as y0 from s),
b as (select image_id, det_id, (a.v*(1-(u-x0))+b.v*(u-x0))*(1-(f.v-y0))+(c.v*(1-(u-x0))+d.v*(u-x0))*(f.v-y0) as z from f
  join grid_cells a using (image_id) join grid_cells b using (image_id) join grid_cells c using (image_id) join grid_cells d using (image_id)
  where a.gy=y0 and a.gx=x0 and b.gy=y0 and b.gx=least(7,x0+1) and c.gy=least(7,y0+1) and c.gx=x0 and d.gy=least(7,y0+1) and d.gx=least(7,x0+1))"""


def _sized(t: Tables) -> DataFrame:
    return t.detections.join(t.images.select("image_id", "width", "height"), "image_id")


@query("J-10 X-08 F-05", f"""
with {_SAMPLES} select image_id, det_id, {r6('p.z')} as roi_cells from detections left join (select image_id, det_id, avg(z) as z from b group by 1, 2) p using (image_id, det_id)""")
def roi_pooling(t: Tables) -> DataFrame:
    d = Q.pool_detections(_sized(t), t.grids, 8, ["cells"])
    return d.select("image_id", "det_id", _r(C("roi_cells"), "roi_cells"))


_RATIO = "(0.5+(det_id*37+image_id*11)%200/100.0::double)"


@query("X-07 A-02", f"""
with d as (select image_id, (x2-x1)/width*20*((y2-y1)/height*20) as cells, {_RATIO} as ratio, path from detections join images using (image_id)),
j as (select regexp_extract(path, '^(.*)/', 1) as folder, image_id, case when ratio <= 1.19::double-0.4::double or (ratio > 1.19::double and cells <= 6.15::double-1.5::double) then 'bad'
  when ratio > 1.19::double and cells > 6.15::double then 'good' else 'unknown' end as d from d)
select folder, image_id, count(*) filter (d='good') as n_good, count(*) filter (d='unknown') as n_unknown, count(*) filter (d='bad') as n_bad,
  cast(grouping_id(folder, image_id) as int) as level from j group by rollup (folder, image_id)""")
def triage_counts(t: Tables) -> DataFrame:
    from fieldlens.functions.text import parent

    d = t.detections.join(t.images, "image_id")
    ratio = F.lit(0.5) + (C("det_id") * 37 + C("image_id") * 11) % 200 / F.lit(100.0)
    decision, _ = Q.triage(ratio, G.cells_covered(Box.of(), C("width"), C("height")), TriageParams())
    return Q.triage_counts(d.select(parent(C("path")).alias("folder"), "image_id", decision.alias("triage_decision")))


@query("I-06 I-04 I-05 G-10 G-11")
def detection_quality(t: Tables) -> DataFrame:
    """The full quality struct per detection; pixels are the 8x8 grids, boxes scaled onto them."""
    prob = F.transform("cells", lambda v: F.abs(v))
    maps = t.grids.select("image_id", C("cells").alias("quality"), prob.alias("blur_probability"), F.transform(prob, lambda p: 1 - 0.7 * p).alias("blur_weight"))
    pixels = _gray(t)
    small = _sized(t).select("image_id", "det_id", F.lit(8).alias("width"), F.lit(8).alias("height"),
                             *[c.alias(n) for n, c in zip(Box._fields, G.scaled(G.normalised(Box.of(), C("width"), C("height")), F.lit(8), F.lit(8)))])
    d = Q.detection_quality(small, maps, pixels, 8)
    return d.select("image_id", "det_id", "quality.triage_decision", _r(C("quality.roi_quality_mean"), "roi_quality_mean"),
                    _r(C("quality.core_ring_sharpness_ratio"), "core_ring_sharpness_ratio"), _r(C("quality.roi_detail_probability"), "roi_detail_probability"))


# ---- scalar functions ----------------------------------------------------------------------------------------------

@query("X-02 X-03 K-03", f"""
with e as (select image_id, gy*8+gx as pos, exp(v - max(v) over (partition by image_id)) as e from grid_cells),
p as (select image_id, pos, e/sum(e) over (partition by image_id) as p from e)
select image_id, {r6('max(p)')} as top, {r6('1 - max(p) filter (pos=63)')} as objectness, {r6('1 - (-sum(p*ln(p+1e-12)))/ln(64)')} as entropy_confidence from p group by 1""")
def softmax_confidences(t: Tables) -> DataFrame:
    a = C("cells")
    return t.grids.select("image_id", _r(F.array_max(R.softmax(a)), "top"), _r(R.objectness(a), "objectness"), _r(R.entropy_confidence(a), "entropy_confidence"))


@query("X-01", f"select image_id, query_id, class_id, {r6('1/(1+exp(-logit))')} as p from logits")
def sigmoid_scores(t: Tables) -> DataFrame:
    from fieldlens.operators.decode import sigmoid

    return t.logits.select("image_id", "query_id", "class_id", _r(sigmoid(C("logit")), "p"))


@query("X-09", f"""
with n as (select image_id, pred, least(100, greatest(0, case when pred < 72.59696108881171 then 72.59696108881171 + 72.59696108881171*(pred-72.59696108881171)/(4*7.798274017370107)
  else 72.59696108881171 + (100-72.59696108881171)*(pred-72.59696108881171)/(4*4.118047289170692) end)) as x from mos)
select image_id, {r6('x')} as normalised, case when x < 20 then 'Bad' when x < 40 then 'Poor' when x < 60 then 'Fair' when x < 80 then 'Good' else 'Excellent' end as category from n""")
def mos_categories(t: Tables) -> DataFrame:
    x = R.normalised_mos(C("pred"))
    return t.mos.select("image_id", _r(x, "normalised"), R.mos_category(x).alias("category"))


@query("X-10 X-11", f"""
select image_id, cast(gy*8+gx as int) as pos, {r6('least(1, greatest(0, (v+0.2)/0.4))')} as stretched, cast(trunc(least(100, greatest(0, 200*v+30))) as int) as percent from grid_cells""")
def stretched_cells(t: Tables) -> DataFrame:
    d = _cells(t.grids.withColumn("z", F.arrays_zip("cells", R.whole_percent(F.transform("cells", lambda v: 200 * v + 30)).alias("percent"))), "z", "z")
    v = C("z.cells")
    return d.select("image_id", "pos", _r(R.stretch(v, F.lit(-0.2), F.lit(0.2)), "stretched"), C("z.percent").alias("percent"))


# ---- masks ---------------------------------------------------------------------------------------------------------

@query("M-01 M-02", """
with r as (select image_id, gy*8+gx as pos, v, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from grid_cells),
q as (select image_id, pos, case when hi-lo < 1.1920929e-07 then 0 else cast(round(255*(v-lo)/(hi-lo)) as int) end as q from r)
select image_id, cast(pos as int) as pos, q, cast(q >= 128 as int) as m from q""")
def quantised_masks(t: Tables) -> DataFrame:
    d = t.grids.select("image_id", R.quantised_mask(C("cells")).alias("q"))
    z = d.select("image_id", F.posexplode(F.arrays_zip("q", R.binary_mask(C("q")).alias("m"))).alias("pos", "z"))
    return z.select("image_id", "pos", "z.q", "z.m")


@query("M-03 M-05 M-08", """
with p as (select image_id, y*8+x as pos, m, y, x, lag(m, 1, 0) over (partition by image_id order by y, x) as prev from mask_pixels),
g as (select *, sum(cast(m <> prev as int)) over (partition by image_id order by pos) as run from p),
r as (select image_id, run, count(*) as n from g group by 1, 2),
a as (select image_id, max(run) as last from r group by 1),
f as (select a.image_id, i as run, coalesce(n, 0) as n from a, unnest(range(cast(a.last as bigint) + 1)) as u(i) left join r on r.image_id=a.image_id and r.run=i)
select image_id, string_agg(cast(n as varchar), ',' order by run) as runs, cast(sum(case when run%2=1 then n else 0 end) as int) as area,
  (select min(x) from p where p.image_id=f.image_id and m=1) as x1, (select min(y) from p where p.image_id=f.image_id and m=1) as y1,
  (select max(x) from p where p.image_id=f.image_id and m=1) as x2, (select max(y) from p where p.image_id=f.image_id and m=1) as y2 from f group by image_id""")
def mask_runs(t: Tables) -> DataFrame:
    d = t.masks.select("image_id", R.run_lengths(C("mask")).alias("runs"), R.mask_box(C("mask"), 8).alias("box"))
    return d.select("image_id", F.array_join(C("runs").cast("array<string>"), ",").alias("runs"), R.runs_area(C("runs")).alias("area"), "box.*")


@query("M-05 F-05", "select image_id, cast(y*8+x as int) as pos, m from mask_pixels")
def mask_round_trip(t: Tables) -> DataFrame:
    runs = R.run_lengths(C("mask"), 1)
    return _cells(t.masks.select("image_id", R.mask_from_runs(runs, 1).alias("mask")), "mask", "m")


@query("M-04", "select image_id, 'rle-binary-v1 | gzip | base64' as format, cast(sum(m) as int) as area from mask_pixels group by 1")
def packed_masks(t: Tables) -> DataFrame:
    entry = t.masks.select("image_id", K.mask_entry(C("mask"), C("width"), C("height")).alias("e"))
    return entry.select("image_id", "e.format", R.runs_area(K.unpack_runs(C("e.data"))).alias("area"))


@query("M-06", """
select image_id, case when image_id%5=0 then 'expected 64 cells, found 63' when image_id%5=1 then 'the first run stands for neither 0 nor 1'
  when image_id%5=2 then 'cell 9 holds 2, which is neither 0 nor 1' end as error from (select distinct image_id from mask_pixels)""")
def mask_violations(t: Tables) -> DataFrame:
    k = C("image_id") % 5
    bad = F.transform("mask", lambda v, i: F.when((k == 2) & (i == 9), F.lit(2)).otherwise(v))
    mask = F.when(k == 0, F.slice("mask", 1, 63)).otherwise(bad)
    return t.masks.select("image_id", R.mask_errors(mask, C("width"), C("height"), F.when(k == 1, F.lit(2)).otherwise(F.lit(0))).alias("error"))


@query("M-07", """
with o as (select unnest(range(40)) as oy), b as (select oy, cast(floor(oy*0.2::double) as int) as a0, greatest(least(cast(ceil((oy+1)*0.2::double) as int), 8), cast(floor(oy*0.2::double) as int)+1) as a1 from o),
s as (select p.image_id, r.oy as oy, c.oy as ox, 2*sum(m) >= count(*) as full_block from b r, b c, mask_pixels p where p.y >= r.a0 and p.y < r.a1 and p.x >= c.a0 and p.x < c.a1 group by 1, 2, 3)
select image_id, cast(oy as int) as row_no, string_agg(case when full_block then '#' else '.' end, '' order by ox) as line from s group by 1, 2""")
def mask_previews(t: Tables) -> DataFrame:
    d = t.masks.select("image_id", K.mask_preview("mask", "width", "height").alias("rows"))
    return d.select("image_id", F.posexplode("rows").alias("row_no", "line"))


@query("M-09", """
with q as (select image_id, y, x, 255*m as v from mask_pixels)
select a.image_id, cast(a.y*8+a.x as int) as pos, case when a.x in (0,7) or a.y in (0,7) then max(a.v) when sum(b.v)//9 < 127 then 0 else 255 end as v
from q a join q b on a.image_id=b.image_id and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1 group by a.image_id, a.y, a.x""")
def smoothed_masks(t: Tables) -> DataFrame:
    gray = F.transform("mask", lambda v: v * 255)
    return _cells(t.masks.select("image_id", gray.alias("g")).select("image_id", R.smoothed_mask(C("g"), 8, 8).alias("g")), "g")


@query("M-10 M-11", """
with q as (select image_id, gy*8+gx as pos, cast(round(least(255, greatest(0, v*800+128))) as int) as m, cast((gy*31+gx*17)%256 as int) as c from grid_cells)
select image_id, cast(pos as int) as pos, case when m > 240 then 255 when m < 10 then 0 else 128 end as alpha,
  cast(floor(c*(m/255.0::double) + 200*(1-m/255.0::double)) as int) as flat, cast(floor((1-0.25)*c + 0.25*m) as int) as mixed from q""")
def composited_pixels(t: Tables) -> DataFrame:
    m = F.transform("cells", lambda v: F.round(R.clamp(v * 800 + 128, 0.0, 255.0), 0).cast("int"))
    c = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.floor(i / 8) * 31 + i % 8 * 17) % 256).cast("int"))
    d = t.grids.select("image_id", m.alias("m"), c.alias("c"))
    z = F.arrays_zip(R.trimap(C("m")).alias("alpha"), R.over_background(C("c"), C("m"), 200).alias("flat"), R.blended(C("c"), C("m"), 0.25).alias("mixed"))
    return d.select("image_id", F.posexplode(z).alias("pos", "z")).select("image_id", "pos", "z.*")


# ---- pixels --------------------------------------------------------------------------------------------------------

def _gray(t: Tables) -> DataFrame:
    return t.grids.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), C("cells").alias("gray"))


@query("I-01 I-07", f"""
select image_id, cast(gy*8+gx as int) as pos, {r6('0.299*v + 0.587*(v*v) + 0.114*abs(v)')} as gray, {r6('((gy*31+gx*17)%256/255.0::double - 0.485)/0.229')} as standard from grid_cells""")
def grayscale_pixels(t: Tables) -> DataFrame:
    v = C("v")
    byte = (C("gy") * 31 + C("gx") * 17) % 256
    return t.grid_cells.select("image_id", (C("gy") * 8 + C("gx")).alias("pos"), _r(Q.grayscale(v, v * v, F.abs(v)), "gray"),
                               _r(Q.normalised_pixels(byte, 0, CHANNEL_MEAN, CHANNEL_STD), "standard"))


_BOXED = """t as (select unnest(range(12)) as k), s as (select k, greatest((k+0.5::double)*8/12-0.5::double, 0) as src from t),
w as (select k, cast(least(floor(src), 6) as int) as i, least(src, 7) - least(floor(src), 6) as f from s)"""


@query("I-07", f"""
with {_BOXED}, b as (select a.image_id, y.k as ty, x.k as tx, (a.v*(1-x.f)+b.v*x.f)*(1-y.f)+(c.v*(1-x.f)+d.v*x.f)*y.f as z from w y, w x, grid_cells a
  join grid_cells b on b.image_id=a.image_id and b.gy=a.gy and b.gx=a.gx+1 join grid_cells c on c.image_id=a.image_id and c.gy=a.gy+1 and c.gx=a.gx
  join grid_cells d on d.image_id=a.image_id and d.gy=a.gy+1 and d.gx=a.gx+1 where a.gy=y.i and a.gx=x.i)
select image_id, cast(ty*16+tx+2 as int) as pos, {r6('(100+100*z)/255')} as v from b
union all select image_id, cast(y.k*16+p as int), {r6('114/255.0::double')} from (select distinct image_id from grid_cells), t y, (select unnest([0, 1, 14, 15]) as p)""")
def letterbox_tensors(t: Tables) -> DataFrame:
    """8 x 8 grids as grey images on a 12 x 16 canvas."""
    pixels = F.transform("cells", lambda v: 100 + 100 * v)
    made = X.letterbox_tensor(12, 16, rounded=False)(pixels, F.lit(8), F.lit(8))
    return t.grids.select("image_id", F.posexplode(made).alias("pos", "v")).select("image_id", "pos", _r(C("v"), "v"))


@query("I-07", f"select image_id, cast(gy*8+gx as int) as pos, {r6('v / greatest(max(v) over (partition by image_id), 1e-6) - 0.5::double')} as v from grid_cells")
def peak_normalised_tensors(t: Tables) -> DataFrame:
    made = X.peak_normalised_tensor(8)("cells", F.lit(8), F.lit(8))
    return t.grids.select("image_id", F.posexplode(made).alias("pos", "v")).select("image_id", "pos", _r(C("v"), "v"))


@query("F-05 J-10", f"""
select image_id, det_id, cast(i//2 as int) as sy, cast(i%2 as int) as sx, {r6('greatest(x1,0)+(i%2+0.5::double)/2*greatest(least(x2,width)-greatest(x1,0),1)')} as x,
  {r6('greatest(y1,0)+(i//2+0.5::double)/2*greatest(least(y2,height)-greatest(y1,0),1)')} as y from detections join images using (image_id), (select unnest(range(4)) as i)""")
def roi_sample_points(t: Tables) -> DataFrame:
    """The points of the table function ``roi_points``, made by a generator so that no row passes through Python."""
    boxes = _sized(t).select("image_id", "det_id", *Box._fields, "width", "height")
    points = boxes.select("image_id", "det_id", F.inline(G.sample_points(Box.of(), C("width"), C("height"), 2)))
    return points.select("image_id", "det_id", "sy", "sx", _r(C("x"), "x"), _r(C("y"), "y"))


@query("F-05 M-05", "select image_id, cast(y*8+x as int) as pos, m from mask_pixels")
def mask_pixels_by_table_function(t: Tables) -> DataFrame:
    register_table_functions(t.spark)
    runs = t.masks.select("image_id", F.posexplode(R.run_lengths(C("mask"), 1)).alias("run_no", "n"))
    return t.spark.sql("select * from run_pixels(table(select * from {runs}), 1)", runs=runs)


@query("I-02", f"select image_id, cast((gy//2)*4+gx//2 as int) as pos, {r6('avg(v)')} as v from grid_cells group by 1, 2")
def half_size_images(t: Tables) -> DataFrame:
    d = _cells(t.grids.select("image_id", R.half_size(C("cells"), 8, 8).alias("h")), "h")
    return d.select("image_id", "pos", _r(C("v"), "v"))


_SOBEL = """n as (select c.image_id, c.gy, c.gx, dy, dx, o.v from grid_cells c, (select unnest([-1,0,1]) as dy), (select unnest([-1,0,1]) as dx), grid_cells o
  where o.image_id=c.image_id and o.gy=least(7,greatest(0,c.gy+dy)) and o.gx=least(7,greatest(0,c.gx+dx))),
e as (select image_id, gy, gx, pow(sum(v*dx*(2-abs(dy))),2)+pow(sum(v*dy*(2-abs(dx))),2) as e from n group by 1, 2, 3)"""


@query("I-03 A-05", f"""
with {_SOBEL} select image_id, cast((gy//2)*4+gx//2 as int) as pos, {r6('avg(e)')} as energy from e group by 1, 2""")
def gradient_tiles(t: Tables) -> DataFrame:
    raw = Q.raw_quality(_gray(t), tiles=4)
    return _cells(raw, "energy_full", "energy").select("image_id", "pos", _r(C("energy"), "energy"))


@query("I-05", f"""
with {_SOBEL}, c as (select image_id, avg(e) filter (gy between 2 and 5 and gx between 2 and 5) as core, avg(e) filter (not (gy between 2 and 5 and gx between 2 and 5)) as ring from e group by 1)
select image_id, {r6('core')} as core, {r6('ring')} as ring, {r6('core/(ring+1e-6)')} as ratio from c""")
def core_ring_sharpness(t: Tables) -> DataFrame:
    """Core and ring of the whole image without smoothing, on the numpy kernel."""
    def kernel(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = [K.crop_sharpness(np.asarray(g).reshape(8, 8), (0, 0, 8, 8), 96.0, 0.02, 0.6, sigma=0.0) for g in b.gray]
            yield pd.DataFrame({"image_id": b.image_id, **{k: [r[k] for r in rows] for k in ("core", "ring", "ratio")}})

    d = _gray(t).mapInPandas(kernel, "image_id bigint, core double, ring double, ratio double")
    return d.select("image_id", *[_r(C(k), k) for k in ("core", "ring", "ratio")])


@query("I-08", """
select image_id, count(*) as n_pixels, cast(sum(m) as bigint) as n_set from mask_pixels
where y >= image_id%4 and y < image_id%4+4 and x >= image_id%3 and x < image_id%3+5 group by 1""")
def cropped_pixels(t: Tables) -> DataFrame:
    from fieldlens.sources.artifacts import crop_pixels

    w = t.masks.select("image_id", "width", "height", C("mask").alias("pixels"), (C("image_id") % 3).cast("int").alias("crop_x1"), (C("image_id") % 4).cast("int").alias("crop_y1"),
                       (C("image_id") % 3 + 5).cast("int").alias("crop_x2"), (C("image_id") % 4 + 4).cast("int").alias("crop_y2"))
    d = w.select("image_id", crop_pixels(C("pixels"), C("width"), Box.of(prefix="crop_")).alias("p"))
    return d.select("image_id", F.size("p").cast("bigint").alias("n_pixels"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("n_set"))


# ---- keypoints -----------------------------------------------------------------------------------------------------

def _heatmaps(t: Tables) -> DataFrame:
    return t.grids.join(t.images.select("image_id", "width", "height"), "image_id").select(
        "image_id", (C("image_id") % 23).cast("int").alias("joint_id"), F.lit(8).alias("map_w"), C("cells").alias("heatmap"), "width", "height")


_PEAKS = """pk as (select image_id, max(v) as confidence, first(gy*8+gx order by v desc, gy, gx) as idx from grid_cells group by 1),
lb as (select pk.*, width, height, idx//8 as py, idx%8 as px, least(256/width, 256/height) as s from pk join images using (image_id)),
o as (select *, (256-cast(trunc(width*s) as int))//2 as ox, (256-cast(trunc(height*s) as int))//2 as oy from lb)"""


@query("K-01 G-20", f"""
with {_PEAKS} select image_id, cast(image_id%23 as int) as joint_id, cast(px as int) as peak_x, cast(py as int) as peak_y, {r6('confidence')} as confidence,
  greatest(0, least(width-1, cast(trunc((px*32-ox)/s) as int))) as x, greatest(0, least(height-1, cast(trunc((py*32-oy)/s) as int))) as y from o""")
def keypoint_peaks(t: Tables) -> DataFrame:
    d = P.decode_peaks(_heatmaps(t))
    return d.select("image_id", "joint_id", "peak_x", "peak_y", _r(C("confidence"), "confidence"), "x", "y")


@query("K-02", f"""
with e as (select image_id, gy, gx, exp(v - max(v) over (partition by image_id)) as e from grid_cells),
p as (select image_id, gy, gx, e/sum(e) over (partition by image_id) as p from e),
m as (select a.image_id, a.gy, a.gx, sum(b.p)/25 as mass from p a join p b on a.image_id=b.image_id and abs(a.gy-b.gy)<=2 and abs(a.gx-b.gx)<=2 group by 1, 2, 3)
select image_id, {r6('max(mass)')} as mass from m group by 1""")
def peak_mass(t: Tables) -> DataFrame:
    return t.grids.select("image_id", _r(K.pooled_peak_udf(8, 8)("cells"), "mass"))


@query("K-04", f"""
with {_PEAKS} select image_id, confidence < 0.1 or px <= 1 or px >= 6 or py <= 1 or py >= 6 or (px*32-ox)/s < 10 or (px*32-ox)/s > width-10
  or (py*32-oy)/s < 10 or (py*32-oy)/s > height-10 as occluded from o""")
def occlusion_flags(t: Tables) -> DataFrame:
    return P.occlusion_flags(P.decode_peaks(_heatmaps(t))).select("image_id", "occluded")


@query("A-30", f"""
select image_id, {r6('min(v)')} as min, {r6('max(v)')} as max, {r6('avg(v)')} as mean, {r6('stddev_pop(v)')} as std, cast(first(gy*8+gx order by v desc, gy, gx) as int) as argmax,
  max(v) > 0.3 as confident from grid_cells group by 1""")
def heatmap_statistics(t: Tables) -> DataFrame:
    s = P.heatmap_statistics(C("cells"))
    return t.grids.select("image_id", *[_r(s[k], k) for k in ("min", "max", "mean", "std")], s["argmax"].alias("argmax"), (s["max"] > 0.3).alias("confident"))


def _points(t: Tables) -> DataFrame:
    """Keypoints per image out of the part table: at most one row per joint."""
    return t.parts.select("image_id", C("part_id").alias("joint_id"), "x", "y", ((C("x") * 7 + C("y") * 3) % 100 / 100).alias("confidence"))


_POINTS = "(select image_id, part_id as joint_id, x, y, (x*7+y*3)%100/100 as confidence from parts)"


@query("A-22", f"""
select image_id, count(*) as total, count(*) filter (confidence > 0.3) as valid, {r6('avg(confidence)')} as avg_confidence, min(confidence) as min_confidence,
  max(confidence) as max_confidence from {_POINTS} group by 1""")
def keypoint_statistics(t: Tables) -> DataFrame:
    return P.keypoint_statistics(_points(t)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("W-13", f"""
with n as (select *, case when joint_id in (3,4,5,6) then 'Mouth' when joint_id in (1,2) then 'Eye' when joint_id in (20,21,22) then 'Tail' else '' end as fam from {_POINTS}),
r as (select *, row_number() over (partition by image_id order by confidence desc, joint_id) as a, row_number() over (partition by image_id, fam order by confidence desc, joint_id) as f from n)
select image_id, joint_id from r where a <= 4 or (fam <> '' and f = 1)""")
def keypoint_shortlist(t: Tables) -> DataFrame:
    return P.keypoint_shortlist(_points(t)).select("image_id", "joint_id")


@query("K-05", f"select image_id, count(*) as n, {r6('max(x) filter (joint_id=1)')} as eye_left_x, {r6('max(confidence) filter (joint_id=7)')} as shoulder_conf from {_POINTS} group by 1")
def keypoint_maps(t: Tables) -> DataFrame:
    m = P.keypoint_map(_points(t))
    at = lambda k, f: F.try_element_at("keypoints", F.lit(k)).getField(f)
    return m.select("image_id", F.size("keypoints").cast("bigint").alias("n"), _r(at("Eye_Left", "x"), "eye_left_x"), _r(at("Shoulder_Left", "confidence"), "shoulder_conf"))


@query("A-21 S-14", f"""
select count(*) as total, count(*) filter (kind <> 'error') as success, count(*) filter (kind = 'error') as failed, {r6("avg(ms) filter (kind <> 'error')")} as avg_ms,
  {r6("sum(ms) filter (kind <> 'error')")} as total_ms from run_events""")
def batch_summary(t: Tables) -> DataFrame:
    s = P.batch_summary(t.run_events.select(F.when(C("kind") == "error", "error").otherwise("success").alias("status"), "ms"))
    return s.select("total", "success", "failed", _r(C("avg_ms"), "avg_ms"), _r(C("total_ms"), "total_ms"))


@query("D-10 K-01 K-04 A-22", f"""
with {_PEAKS} select cast(image_id%23 as int) as joint_id, count(*) as n, count(*) filter (confidence > 0.2) as valid, {r6('avg(confidence)')} as avg_confidence from o group by 1""")
def pose_batch(t: Tables) -> DataFrame:
    d = P.decode_peaks(_heatmaps(t))
    return d.groupBy("joint_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("confidence") > 0.2).alias("valid"), _r(F.avg("confidence"), "avg_confidence"))
