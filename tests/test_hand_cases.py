"""Small exact expectations: names, masks, triage, quality, poses, params, augmentation, properties."""

import base64
import gzip
import math

import numpy as np
import pandas as pd
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions import grids as R
from fieldlens.functions import kernels as K
from fieldlens.functions import text
from fieldlens.functions.geometry import Box
from fieldlens.operators import dataset as D
from fieldlens.operators import pose as P
from fieldlens.operators import quality as Q
from fieldlens.operators import selection as S
from fieldlens.operators import training as L
from fieldlens.schemas import CHANNEL_MEAN, CHANNEL_STD, KEYPOINT_NAMES, QualityParams, TriageParams

C = F.col


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_extensions(spark):
    names = ["test.jpg", "test.jpeg", "test.png", "test.webp", "test.bmp", "test.tiff", "test.tif", "TEST.JPG", "test.txt", "test.gif", "test", "/a.b/test", "/x/.jpg"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(text.is_supported(C("p"))).collect()]
    assert got == [True] * 8 + [False] * 5


def test_output_names(spark):
    lit = F.lit
    got = one(
        spark, text.numbered_output_path(lit("/d/test.jpg"), lit("crop"), lit(1), lit(1), lit("jpg")),
        text.numbered_output_path(lit("/d/test.jpg"), lit("crop"), lit(2), lit(5), lit("jpg")),
        text.numbered_output_path(lit("/d/test.jpg"), lit("crop"), lit(5), lit(12), lit("jpg")),
        text.numbered_output_path(lit("/d/test_crop.jpg"), lit("crop"), lit(123), lit(200), lit("jpg")),
        text.output_path(lit("/d/test_cutout.jpg"), lit("cutout"), lit("png")), text.relative_to(lit("/m/test_crop.jpg"), lit("/m")),
        text.relative_to(lit("/m/subdir/test_crop.jpg"), lit("/m")), text.relative_to(lit("/other/a.jpg"), lit("/m")),
        text.versioned_name(lit("model.onnx"), F.md5(lit("hello world"))), text.stem(lit("/a/b.tar.gz")), text.stem(lit("/a/.hidden")))
    assert list(got) == ["/d/test_crop.jpg", "/d/test_crop-2.jpg", "/d/test_crop-05.jpg", "/d/test_crop-123.jpg", "/d/test_cutout.png", "test_crop.jpg",
                         "subdir/test_crop.jpg", "/other/a.jpg", "model-5eb63bbbe01eeed093cb22bb8f5acdc3.onnx", "b.tar", ".hidden"]


@pytest.mark.parametrize("mask,start,error", [
    ([0, 1, 0], 0, "expected 4 cells, found 3"), ([0, 1, 0, 1], 2, "the first run stands for neither 0 nor 1"),
    ([0, 1, 2, 1], 0, "cell 2 holds 2, which is neither 0 nor 1"), ([0, 1, 1, 1], 0, None)])
def test_mask_errors(spark, mask, start, error):
    df = spark.createDataFrame([(mask, start)], "m array<int>, s int")
    assert df.select(R.mask_errors(C("m"), F.lit(2), F.lit(2), C("s"))).first()[0] == error


def test_mask_entry_round_trip(spark):
    rng = np.random.default_rng(0)
    masks = [rng.integers(0, 2, 35).tolist() for _ in range(20)] + [[1] * 35, [0] * 35]
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    for start in (0, 1):
        e = df.select("m", K.mask_entry(C("m"), F.lit(7), F.lit(5), start).alias("e")).select("m", "e.*")
        for r in e.withColumn("back", R.mask_from_runs(K.unpack_runs("data"), start)).collect():
            assert r.back == r.m and (r.width, r.height, r.format) == (7, 5, "rle-binary-v1 | gzip | base64")
            runs = [int(v) for v in gzip.decompress(base64.b64decode(r.data)).decode().split(",")]
            assert sum(runs) == 35 and all(v > 0 for v in runs[1:])


def test_preview():
    m = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]])
    assert K.ascii_preview(m, 4, 4) == ["##..", "##..", "..##", "..##"]
    assert [K.preview_size(*s) for s in ((1280, 960), (960, 1280), (1000, 1000), (1600, 400))] == [(40, 30), (30, 40), (40, 40), (40, 10)]


def test_triage(spark):
    p = TriageParams(1.0, 5.0, 0.2, 1.0, 0.1, 0.5)
    df = spark.createDataFrame([(0.7, 8.0), (1.5, 3.0), (1.5, 8.0), (0.9, 8.0)], "r double, c double")
    rows = df.select(*[c.alias(n) for c, n in zip(Q.triage(C("r"), C("c"), p), ("d", "why"))]).collect()
    assert [r.d for r in rows] == ["bad", "bad", "good", "unknown"]
    assert all(r.why.startswith(r.d) for r in rows)
    d = TriageParams()
    assert (d.ratio_bad, d.cells_bad, d.delta_bad_ratio, d.delta_bad_cells, d.delta_good_ratio, d.delta_good_cells) == (1.19, 6.15, 0.4, 1.5, 0, 0)


def test_quality_scores(spark):
    raw = spark.createDataFrame([(1, [1.0] * 400, [0.5] * 400, 0.5, 90.0)], "image_id int, energy_full array<double>, energy_half array<double>, ratio double, global_score double")
    s = Q.score_quality(raw, [QualityParams()]).first()
    assert s.blur_score < 0.5 and s.final_score > 85
    cells = Q.scored_cells(raw).first()
    np.testing.assert_allclose(cells.blur_probability, s.blur_probability)
    np.testing.assert_allclose(cells.blur_weights, s.blur_weights)
    w, f = one(spark, R.blur_weight(F.lit(0.5), F.lit(0.7), F.lit(0.2)), R.either(F.array(F.lit(0.3)), F.array(F.lit(0.2)))[0])
    assert abs(w - 0.65) < 1e-12 and abs(f - 0.44) < 1e-12
    assert QualityParams().violations() == [] and QualityParams(alpha=1.5).violations() == ["alpha=1.5 outside [0.0, 1.0]"]


def test_blur_falls_with_energy(spark):
    e = np.linspace(0, 2, 50).tolist()
    p = spark.createDataFrame([(e,)], "e array<double>").select(R.blur_probability(C("e"), F.lit(0.02), F.lit(1.2), F.lit(0.0))).first()[0]
    assert all(a >= b for a, b in zip(p, p[1:])) and p[0] == 1.0


def test_gradient_kernel_matches_array_form(spark, tables):
    got = {r.image_id: r.energy_half for r in Q.raw_quality(tables.grids.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), C("cells").alias("gray")), tiles=2).collect()}
    half = {r.image_id: r.h for r in tables.grids.select("image_id", R.half_size(C("cells"), 8, 8).alias("h")).collect()}
    for k in list(got)[:30]:
        np.testing.assert_allclose(got[k], K.tile_means(K.gradient_energy(np.array(half[k]).reshape(4, 4)), 2).ravel(), rtol=1e-9)


def test_uneven_tiles():
    v = np.arange(64.0).reshape(8, 8)
    want = [[v[a:b, c:d].mean() for c, d in ((0, 2), (2, 5), (5, 8))] for a, b in ((0, 2), (2, 5), (5, 8))]
    np.testing.assert_allclose(K.tile_means(v, 3), want)


def test_crop_sharpness_edges():
    gray = np.random.default_rng(0).random((20, 30))
    s = K.crop_sharpness(gray, (-5, -5, 100, 100), 96, 0.02, 0.6)
    assert 0 <= s["detail"] <= 1 and s["ratio"] == s["core"] / (s["ring"] + 1e-6)
    assert K.crop_sharpness(gray, (5, 5, 5, 9), 96, 0.02, 0.6)["detail"] is None
    flat = K.crop_sharpness(np.ones((9, 9)), (0, 0, 9, 9), 96, 0.02, 0.6)
    assert flat["core"] < 1e-20 and flat["ring"] < 1e-20
    k = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    spot = np.zeros((9, 9)); spot[4, 4] = 1
    np.testing.assert_allclose(K.gaussian(spot, 1.0)[4, 2:7], k / k.sum() * (k / k.sum())[2])


def test_normalised_white_pixel(spark):
    got = one(spark, *[Q.normalised_pixels(F.lit(255), i, CHANNEL_MEAN, CHANNEL_STD) for i in range(3)])
    np.testing.assert_allclose(list(got), [(1 - m) / s for m, s in zip(CHANNEL_MEAN, CHANNEL_STD)])


def test_cutout_pixel(spark):
    m, c = F.array(F.lit(255), F.lit(0), F.lit(128)), F.array(F.lit(255), F.lit(255), F.lit(255))
    assert list(one(spark, R.over_background(c, m, 0), R.trimap(m))) == [[255, 0, 128], [255, 0, 128]]


def test_mos_category_is_capped(spark):
    assert list(one(spark, *[R.mos_category(R.normalised_mos(F.lit(v))) for v in (100.0, 72.59696108881171, 0.0)])) == ["Excellent", "Good", "Bad"]


def test_first_peak_and_names(spark):
    df = spark.createDataFrame([(1, 30, 2, [0.5, 0.9, 0.9, 0.1], 512, 256)], "image_id int, joint_id int, map_w int, heatmap array<double>, width int, height int")
    r = P.decode_peaks(df).first()
    assert (r.peak_x, r.peak_y, r.confidence) == (1, 0, 0.9)
    assert [x[0] for x in spark.range(25).select(P.joint_name(C("id").cast("int"))).collect()] == [*KEYPOINT_NAMES, "keypoint_23", "keypoint_24"]


def test_geometry_properties(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, (200, 8)).astype(float)
    for k in (0, 4):
        a[:, k + 2] += a[:, k]; a[:, k + 3] += a[:, k + 1]
    df = spark.createDataFrame(pd.DataFrame(a, columns=["x1", "y1", "x2", "y2", "x1_b", "y1_b", "x2_b", "y2_b"]))
    p, q = Box.of(), Box.of(suffix="_b")
    rows = df.select(G.iou(p, q).alias("i"), G.iou(q, p).alias("j"), G.generalized_iou(p, q).alias("g")).collect()
    assert all(r.i == r.j and 0 <= r.i <= 1 for r in rows) and all(r.g is None or -1 <= r.g <= r.i for r in rows)
    zero = one(spark, G.iou(*[Box(*[F.lit(1.0)] * 4)] * 2, "ratio"), G.iou(*[Box(*[F.lit(1.0)] * 4)] * 2))
    assert list(zero) == [None, 0.0]


def test_orientation_of_equal_points_is_null(spark):
    assert one(spark, G.orientation(*[F.lit(2.0)] * 4))[0] is None


def test_wrap_angle_range(spark):
    rows = spark.range(-50, 50).select(G.wrap_angle(C("id") * 0.37).alias("w"), (C("id") * 0.37).alias("t")).collect()
    assert all(-math.pi <= r.w < math.pi and abs(math.sin(r.w) - math.sin(r.t)) < 1e-9 for r in rows)


def test_halves_and_sampling(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    a, b = ({r.k: r.split for r in S.shuffled_halves(d, "k", 42).collect()} for d in (df, df.repartition(7)))
    assert a == b and sum(v == "valid" for v in a.values()) == 50
    assert a != {r.k: r.split for r in S.shuffled_halves(df, "k", 43).collect()}
    s = S.sample_rows(spark.range(20000), "id", 0.3, 5)
    assert s.count() == S.sample_rows(spark.range(20000).repartition(3), "id", 0.3, 5).count() and abs(s.count() / 20000 - 0.3) < 0.02


def test_strict_mode(spark):
    req = spark.createDataFrame([("/a/test.jpg",), ("/a/test.txt",), ("/a/gone.png",)], "path string")
    good, rejects = S.check_requested(req, spark.createDataFrame([("/a/test.jpg",), ("/a/test.txt",)], "path string"))
    assert [r.path for r in good.collect()] == ["/a/test.jpg"]
    assert {r.path: r.reason for r in rejects.collect()} == {"/a/test.txt": "unsupported", "/a/gone.png": "missing"}
    with pytest.raises(ValueError, match="rejected"):
        S.require_none(rejects, "rejected image")


def test_augmentation(spark):
    t = spark.createDataFrame([(i, 1, 800, 600, 100.0, 120.0, 500.0, 480.0, 144000.0, 0.5 if i % 2 else None) for i in range(200)],
                              "image_id bigint, det_id int, width int, height int, x1 double, y1 double, x2 double, y2 double, area double, orient double")
    rows = D.augment_targets(t, 2, seed=3).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, D.augment_targets(t.repartition(5), 2, seed=3).collect()), key=repr)
    assert {r.flipped for r in rows} == {r.cropped for r in rows} == {True, False}
    for r in rows:
        assert 0 <= r.x1 < r.x2 <= r.width + 1e-6 and 0 <= r.y1 < r.y2 <= r.height + 1e-6
        assert min(r.width, r.height) == 560 or max(r.width, r.height) <= 1333
        assert (r.orient is None) == (r.image_id % 2 == 0)
        if not r.cropped:
            s = 560 / 600
            assert abs(r.area - 144000 * (r.width / 800) * (r.height / 600)) < 1e-6
            want = 300 * r.width / 800 if r.flipped else 100 * r.width / 800
            assert abs(r.x1 - want) < 1e-9 and abs(r.y1 - 120 * s) < 1e-9


def test_early_stop_ignores_small_gains(spark):
    values = [0.5, 0.5005, 0.502, 0.5, 0.503, 0.4, 0.4, 0.4]
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, epoch int, value double")
    trace = L.early_stop_trace(log, ["run"], patience=3, min_delta=0.001).orderBy("epoch").collect()
    assert [r.best for r in trace] == [0.5, 0.5, 0.502, 0.502, 0.502, 0.502, 0.502, 0.502]  # 0.503 is not above 0.502 + 0.001
    assert [r.waited for r in trace] == [0, 1, 0, 1, 2, 3, 4, 5]
    assert L.stop_epoch(L.early_stop_trace(log, ["run"], patience=3), ["run"]).first().stop_epoch == 5


def _fold(values, step):
    best, out = 0.0, []
    for i, v in enumerate(values):
        if v is not None and v > best + step:
            best = v
            out.append((i + 1, v))
    return out


@pytest.mark.parametrize("step", [0.0, 0.004, 0.3])
def test_improvements_by_parallel_scan_equal_the_fold(spark, step):
    """Small slices and fan-in, so that one run with a third of the log crosses several levels of the tree."""
    from fieldlens.operators.scan import improving_rows

    rng = random.Random(5)
    runs = {"rising": [i / 400 for i in range(400)], "noisy": [min(1.0, i / 300 + rng.gauss(0, 0.05)) for i in range(300)],
            "falling": [1 - i / 50 for i in range(50)], "odd": [None, float("nan"), 0.2, None, 0.2, 0.21, float("nan"), 0.6], "never": [-1.0, 0.0, 0.0]}
    rows = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)]
    log = spark.createDataFrame(rows, "run string, epoch int, value double")
    got = improving_rows(log, ["run"], "epoch", "value", step, slice_rows=8, fan_in=3)
    clean = lambda vs: [None if v is None or v != v else v for v in vs]
    want = sorted((r, *p) for r, vs in runs.items() for p in _fold(clean(vs), step))
    assert sorted(map(tuple, got.collect())) == want
    assert improving_rows(log.where("false"), ["run"], "epoch", "value", step).count() == 0
    one = improving_rows(log.where("run = 'noisy'").drop("run"), [], "epoch", "value", step, slice_rows=16, fan_in=2)
    assert sorted(map(tuple, one.collect())) == _fold(runs["noisy"], step)


def test_roi_mean_equals_sampling(spark):
    from fieldlens.functions import kernels

    rng = random.Random(9)
    side, n = 20, 8
    rows = []
    for i in range(200):
        x, y = rng.uniform(-20, 90), rng.uniform(-20, 60)
        rows.append(([rng.random() for _ in range(side * side)], x, y, x + rng.uniform(-5, 60), y + rng.uniform(0, 60), 100, 80))
    rows += [(None, 0.0, 0.0, 1.0, 1.0, 100, 80), (rows[0][0], None, 0.0, 1.0, 1.0, 100, 80)]

    def plain(g, x1, y1, x2, y2, w, h):
        if g is None or x1 is None:
            return None
        x0, y0 = max(x1, 0), max(y1, 0)
        bw, bh = max(min(x2, w) - x0, 1), max(min(y2, h) - y0, 1)
        total = 0.0
        for sy in range(n):
            for sx in range(n):
                u = min(max((x0 + (sx + 0.5) / n * bw) / w * side, 0), side - 0.001)
                v = min(max((y0 + (sy + 0.5) / n * bh) / h * side, 0), side - 0.001)
                i, j = int(u), int(v)
                at = lambda r, c: g[min(r, side - 1) * side + min(c, side - 1)]
                total += ((at(j, i) * (1 - u + i) + at(j, i + 1) * (u - i)) * (1 - v + j) + (at(j + 1, i) * (1 - u + i) + at(j + 1, i + 1) * (u - i)) * (v - j))
        return total / n / n

    df = spark.createDataFrame(rows, "g array<double>, x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = [r.m for r in df.select(kernels.roi_mean(side)("g", "x1", "y1", "x2", "y2", "w", "h").alias("m")).collect()]
    for a, b in zip(got, [plain(*r) for r in rows]):
        assert (a is None and b is None) or abs(a - b) < 1e-12


def test_tensors(spark):
    from fieldlens.functions import tensors as X

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (4, 6, 3)).astype(float)
    rows = [(image.ravel().tolist(), 4, 6), (rng.integers(0, 256, (5, 5, 1)).astype(float).ravel().tolist(), 5, 5), (None, 4, 6), ([0.0] * 4, 2, 2)]
    df = spark.createDataFrame(rows, "p array<double>, h int, w int")
    boxed = [r.t for r in df.select(X.letterbox_tensor(12, 12)("p", "h", "w").alias("t")).collect()]
    got = np.array(boxed[0]).reshape(3, 12, 12)
    assert (got[:, :2] == 114 / 255).all() and (got[:, 10:] == 114 / 255).all() and boxed[2] is None
    at = lambda n, k: min(max((k + 0.5) * n / (2 * n) - 0.5, 0), n - 1)
    for y in range(8):
        for x in range(12):
            v, u = at(4, y), at(6, x)
            i, j = min(int(v), 2), min(int(u), 4)
            z = (image[i, j] * (1 - u + j) + image[i, j + 1] * (u - j)) * (1 - v + i) + (image[i + 1, j] * (1 - u + j) + image[i + 1, j + 1] * (u - j)) * (v - i)
            assert np.abs(got[:, y + 2, x] * 255 - z).max() <= 0.5 + 1e-9
    same = [r.t for r in df.select(X.square_tensor(5, (0.5,), (0.25,))("p", "h", "w").alias("t")).collect()]
    assert np.allclose(same[1], (np.array(rows[1][0]) / 255 - 0.5) / 0.25)  # the same size: the kernel is 1 at 0 and 0 at whole numbers
    peak = [r.t for r in df.select(X.peak_normalised_tensor(5)("p", "h", "w").alias("t")).collect()]
    assert np.allclose(peak[1], np.array(rows[1][0]) / max(rows[1][0]) - 0.5) and set(peak[3]) == {-0.5}
    for n, m in ((9, 4), (4, 9), (7, 1), (1, 5)):
        for kernel in ("linear", "lanczos"):
            w = X.resize_matrix(n, m, kernel, True)
            assert w.shape == (m, n) and np.allclose(w.sum(axis=1), 1)
    with pytest.raises(Exception, match="no image"):
        df.limit(1).select(X.letterbox_tensor(4, 4)("p", F.lit(7), "w")).collect()


def test_table_functions(spark):
    from fieldlens.functions import table_functions as TF

    TF.register_table_functions(spark)
    runs = [("b", 1, 3), ("a", 0, 2), ("b", 0, 0), ("a", 2, 1), ("a", 1, None), ("b", 2, 1)]
    spark.createDataFrame(runs, "name string, no int, n int").createOrReplaceTempView("runs_of_masks")
    got = spark.sql("select * from run_pixels(table(runs_of_masks), 1)").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 1)] and got[0].__fields__ == ["name", "pos", "m"]
    points = spark.sql("select sy, sx, x, y from (select -4D as x1, 1D as y1, 6D as x2, 50D as y2) b, lateral roi_points(x1, y1, x2, y2, 10D, 9D, 2)").collect()
    assert sorted(map(tuple, points)) == [(0, 0, 1.5, 3.0), (0, 1, 4.5, 3.0), (1, 0, 1.5, 7.0), (1, 1, 4.5, 7.0)]
    assert spark.sql("select * from roi_points(cast(null as double), 1D, 6D, 50D, 10D, 9D, 2)").count() == 0


def test_previews_of_a_batch_hold_few_lines_as_python_strings(monkeypatch):
    import pyarrow as pa

    from fieldlens.functions import kernels as K

    n, live = 600, []
    real = K.ascii_preview
    monkeypatch.setattr(K, "ascii_preview", lambda *a: live.append(1) or real(*a))
    made = []
    array = pa.array
    monkeypatch.setattr(K.pa, "array", lambda x, *a: made.append(len(x)) or array(x, *a))
    mask = array([[i % 2] * 32 + [0] * 32 for i in range(n)], pa.list_(pa.int32()))
    out = K._previews(mask, array([8] * n), array([8] * n)).to_pylist()
    assert len(out) == len(live) == n and max(made) <= 128 and out[0] != out[1] and out[1] == out[599]
    assert K._previews(mask.slice(0, 0), array([], pa.int32()), array([], pa.int32())).to_pylist() == []


def test_sample_points_are_those_of_the_table_function(spark):
    from fieldlens.functions import geometry as G
    from fieldlens.functions.table_functions import register_table_functions

    register_table_functions(spark)
    boxes = spark.sql("select * from values (-4D, 1D, 6D, 50D, 10D, 9D), (2.5D, 3D, 2D, 3.1D, 10D, 9D), (cast(null as double), 1D, 6D, 50D, 10D, 9D) as t(x1, y1, x2, y2, width, height)")
    got = boxes.select("x1", F.inline(G.sample_points(G.Box.of(), F.col("width"), F.col("height"), 3))).collect()
    want = spark.sql("select b.x1, p.* from {b} b, lateral roi_points(x1, y1, x2, y2, width, height, 3) p", b=boxes).collect()
    assert len(got) == 18 and sorted(got) == sorted(want)


def test_only_detections_with_a_grid_pass_through_python(spark):
    from fieldlens.operators import quality as Q

    rows = spark.range(200).selectExpr("id as image_id", "0D as x1", "0D as y1", "4D as x2", "4D as y2", "8 as width", "8 as height")
    maps = spark.range(3).selectExpr("id as image_id", "array_repeat(cast(id as double), 64) as g")
    pooled = Q.pool_detections(rows, maps, 8, ["g"])
    assert {r.image_id: r.roi_g for r in pooled.collect()} == {i: float(i) if i < 3 else None for i in range(200)}
    assert "LeftAnti" in pooled._jdf.queryExecution().optimizedPlan().toString()
