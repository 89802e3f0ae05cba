"""Overlap joins, greedy matching and assignment against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import matching as M
from fieldlens.schemas import AREA_RANGES


def boxes(rng, n, images=3, span=600, big=200):
    x, y = rng.integers(-50, span, n), rng.integers(-50, span, n)
    w, h = rng.integers(0, big, n), rng.integers(0, big, n)
    return pd.DataFrame({
        "image_id": rng.integers(0, images, n), "det_id": np.arange(n, dtype=np.int32), "class_id": rng.integers(0, 2, n).astype(np.int32),
        "x1": x.astype(float), "y1": y.astype(float), "x2": (x + w).astype(float), "y2": (y + h).astype(float),
        "confidence": rng.integers(0, 50, n) / 50})


def iou(a, b):
    iw, ih = min(a.x2, b.x2) - max(a.x1, b.x1), min(a.y2, b.y2) - max(a.y1, b.y1)
    if iw < 0 or ih < 0:
        return 0.0
    u = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - iw * ih
    return iw * ih / u if u > 0 else 0.0


@pytest.mark.parametrize("cell", [16, 100, 256, 5000])
def test_overlap_pairs(spark, cell):
    rng = np.random.default_rng(cell)
    a, b = boxes(rng, 80), boxes(rng, 90)
    got = M.overlap_pairs(spark.createDataFrame(a), spark.createDataFrame(b), ["image_id"], 0.1, cell=cell)
    got = {(r.det_id, r.det_id_b): r.iou for r in got.collect()}
    want = {(p.det_id, q.det_id): iou(p, q) for p in a.itertuples() for q in b.itertuples() if p.image_id == q.image_id and iou(p, q) > 0.1}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_overlap_pairs_hot_image_skips_far_boxes(spark):
    """In one crowded image the join meets neighbours only, not all pairs."""
    n = 3000
    pdf = pd.DataFrame({"image_id": 1, "det_id": np.arange(n), "x1": np.arange(n) * 300.0, "y1": 0.0, "x2": np.arange(n) * 300.0 + 100, "y2": 100.0})
    df = spark.createDataFrame(pdf)
    assert M.overlap_pairs(df, df, ["image_id"], 0.5).count() == n


def greedy(preds, truths, thr, area):
    """Plain greedy matching of one image and class."""
    lo, hi = AREA_RANGES[area]
    size = lambda b: (b.x2 - b.x1) * (b.y2 - b.y1)
    gt = [(g, bool(g.iscrowd) or not lo <= size(g) <= hi) for g in truths.itertuples()]
    gt.sort(key=lambda e: (e[1], e[0].det_id))
    taken, out = set(), {}
    for p in preds.sort_values(["confidence", "det_id"], ascending=[False, True]).itertuples():
        best, pick = thr, None
        for g, ignored in gt:
            if g.det_id in taken and not g.iscrowd:
                continue
            if pick is not None and not pick[1] and ignored:
                break
            v = iou(p, g)
            if g.iscrowd:
                iw, ih = max(0, min(p.x2, g.x2) - max(p.x1, g.x1)), max(0, min(p.y2, g.y2) - max(p.y1, g.y1))
                v = iw * ih / size(p) if size(p) else 0.0
            if v >= best and iou(p, g) > 0:
                best, pick = v, (g, ignored)
        if pick:
            taken.add(pick[0].det_id)
        out[p.det_id] = (int(pick is not None and not pick[1]), int(pick[1]) if pick else int(not lo <= size(p) <= hi))
    return out


def test_greedy_matches(spark):
    rng = np.random.default_rng(5)
    p, t = boxes(rng, 150, span=150, big=120), boxes(rng, 90, span=150, big=120)
    t["iscrowd"] = (rng.random(len(t)) < 0.15).astype(np.int32)
    thresholds, areas = (0.5, 0.6, 0.75), tuple(AREA_RANGES)
    got = M.greedy_matches(spark.createDataFrame(p), spark.createDataFrame(t), thresholds, areas).collect()
    assert len(got) == len(p) * len(areas)
    want = {}
    for (image, cls), ps in p.groupby(["image_id", "class_id"]):
        ts = t[(t.image_id == image) & (t.class_id == cls)]
        for area in areas:
            for i, thr in enumerate(thresholds):
                for d, flags in greedy(ps, ts, thr, area).items():
                    want[d, area, i] = flags
    for r in got:
        for i in range(len(thresholds)):
            assert (r.tp[i], r.ignored[i]) == want[r.det_id, r.area_range, i], (r, i)


def test_greedy_limit(spark):
    rng = np.random.default_rng(6)
    p, t = boxes(rng, 60, images=1), boxes(rng, 20, images=1)
    out = M.greedy_matches(spark.createDataFrame(p), spark.createDataFrame(t), (0.5,), max_dets=5)
    assert out.groupBy("class_id").count().agg(F.max("count")).first()[0] == 5


def test_greedy_with_more_truths_than_limit(spark):
    rng = np.random.default_rng(8)
    p, t = boxes(rng, 12, images=1, span=20, big=60), boxes(rng, 80, images=1, span=20, big=60)
    p["class_id"] = t["class_id"] = np.int32(0)
    t["iscrowd"] = np.int32(0)
    got = {r.det_id: (r.tp[0], r.ignored[0]) for r in M.greedy_matches(spark.createDataFrame(p), spark.createDataFrame(t), (0.3,), max_dets=6).collect()}
    best = p.sort_values(["confidence", "det_id"], ascending=[False, True]).head(6)
    assert got == greedy(best, t, 0.3, "all")


def test_best_match_prefers_first_on_ties(spark):
    base = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0)], "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double")
    cand = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 5.0), (1, 3, 0.0, 5.0, 10.0, 10.0)], base.schema)
    rows = {r.det_id: (r.match_id, r.iou) for r in M.best_matches(base, cand, ["image_id"], "det_id", "det_id").collect()}
    assert rows == {0: (3, 0.5), 1: (None, 0.0)}


@pytest.mark.parametrize("shape", [(3, 5), (5, 3), (4, 4), (1, 6), (6, 1)])
def test_assignment(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(40):
        cost = rng.normal(size=shape).round(2)
        rows, cols = M._assign(cost)
        n = min(shape)
        assert len(set(rows)) == len(set(cols)) == n
        wide = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), n))
        assert abs(cost[rows, cols].sum() - best) < 1e-9


def test_match_costs_keep_every_pair(spark):
    q = spark.createDataFrame([(1, 400, [0.0], 0.0, 0.0, 1.0, 1.0)], "image_id long, query_id int, logits array<double>, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame([(1, i, 0, 0.0, 0.0, 1.0, 1.0 + i) for i in range(400)], "image_id long, target_id int, class_id int, x1 double, y1 double, x2 double, y2 double")
    costs = M.match_costs(q, t)
    assert costs.count() == 400
    assert [(r.query_id, r.target_id) for r in M.assign_targets(costs).collect()] == [(400, 0)]


def test_query_groups_with_a_crowded_image(spark):
    """Image 1 has more targets than queries in one group and fewer in the other; blocks of 4 spread its pairs over join keys."""
    rng = np.random.default_rng(12)
    box = lambda: [float(v) for v in (lambda x, y, w, h: (x, y, x + w, y + h))(*rng.uniform(0.05, 0.5, 4))]
    q = [(image, g, 100 * g + i, [float(v) for v in rng.normal(size=3)], *box()) for image, sizes in ((1, (6, 30)), (2, (3, 2)), (3, (1, 1)))
         for g, n in enumerate(sizes) for i in range(n)]
    t = [(image, i, int(rng.integers(3)), *box()) for image, n in ((1, 17), (2, 3), (4, 2)) for i in range(n)]
    queries = spark.createDataFrame(q, "image_id long, query_group int, query_id int, logits array<double>, x1 double, y1 double, x2 double, y2 double")
    targets = spark.createDataFrame(t, "image_id long, target_id int, class_id int, x1 double, y1 double, x2 double, y2 double")
    got: dict = {}
    for r in M.assign_query_groups(queries, targets, block=4).collect():
        got.setdefault((r.image_id, r.query_group), []).append((r.query_id, r.target_id, r.cost))
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    cost = {(r.image_id, r.query_id, r.target_id): r.cost for r in M.match_costs(queries, targets).collect()}
    for (image, g), rows in got.items():
        qs, ts = [r[2] for r in q if r[:2] == (image, g)], [r[1] for r in t if r[0] == image]
        assert len({r[0] for r in rows}) == len({r[1] for r in rows}) == len(rows) == min(len(qs), len(ts))
        matrix = np.array([[cost[image, a, b] for b in ts] for a in qs])
        i, j = M._assign(matrix)
        assert abs(sum(r[2] for r in rows) - matrix[i, j].sum()) < 1e-9


def test_problems_solved_together_cost_what_each_costs_alone():
    from fieldlens.operators.matching import _assign, _solved

    rng = np.random.default_rng(11)
    problem, q, t, cost, want = [], [], [], [], 0.0
    for k in range(300):
        n, m = rng.integers(1, 7, 2)
        c = np.round(rng.random((n, m)), 1 + k % 3)
        rows, cols = _assign(c)
        want += c[rows, cols].sum()
        problem += [k] * (n * m)
        q += list(np.repeat(rng.permutation(50)[:n], m)); t += list(np.tile(rng.permutation(50)[:m], n)); cost += list(c.ravel())
    mixed = rng.permutation(len(cost))
    problem, q, t, cost = (np.array(x)[mixed] for x in (problem, q, t, cost))
    at = _solved(problem, q, t, cost, 300)
    assert abs(cost[at].sum() - want) < 1e-9
    for ids in (q, t):
        assert len(set(zip(problem[at], ids[at]))) == len(at)


@pytest.mark.parametrize("limit", [4096, 10])
def test_match_bits_inside_rows_and_over_tiles(spark, monkeypatch, limit):
    """One row per prediction, no boxes shuffled by tile for ordinary images; crowded images give the same flags over tiles."""
    rng = np.random.default_rng(15)
    p, t = boxes(rng, 150, span=150, big=120), boxes(rng, 90, span=150, big=120)
    t["iscrowd"] = (rng.random(len(t)) < 0.15).astype(np.int32)
    thresholds, areas = (0.5, 0.75), tuple(AREA_RANGES)
    monkeypatch.setattr(M, "CROWD", limit)
    got = {r.det_id: (r.tp, r.ignored) for r in M.match_bits(spark.createDataFrame(p), spark.createDataFrame(t), thresholds, areas).collect()}
    assert len(got) == len(p)
    for (image, cls), ps in p.groupby(["image_id", "class_id"]):
        ts = t[(t.image_id == image) & (t.class_id == cls)]
        for k, area in enumerate(areas):
            for i, thr in enumerate(thresholds):
                for d, flags in greedy(ps, ts, thr, area).items():
                    assert tuple(x >> (k * 2 + i) & 1 for x in got[d]) == flags


@pytest.mark.parametrize("limit", [4096, 10])
def test_best_matches_inside_rows_and_over_tiles(spark, monkeypatch, limit):
    rng = np.random.default_rng(21)
    a, b = boxes(rng, 90, span=150, big=120), boxes(rng, 80, span=150, big=120)
    monkeypatch.setattr(M, "CROWD", limit)
    out = M.best_matches(spark.createDataFrame(a), spark.createDataFrame(b), ["image_id"], "det_id", "det_id", 0.1, keep=("class_id",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    got = {r.det_id: r for r in out.collect()}
    assert len(got) == len(a)
    for p in a.itertuples():
        near = [(-iou(p, q), q.det_id, q.class_id) for q in b.itertuples() if q.image_id == p.image_id and iou(p, q) > 0.1]
        v, d, c = min(near) if near else (0.0, None, None)
        r = got[p.det_id]
        assert (r.match_id, r.match_class_id, r.confidence) == (d, c, p.confidence) and abs(r.iou + v) < 1e-12
