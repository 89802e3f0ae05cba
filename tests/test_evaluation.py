"""Average precision, summary statistics and correlations against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import evaluation as E
from fieldlens.operators import matching as M
from fieldlens.schemas import AREA_RANGES, IOU_THRESHOLDS
from tests.test_matching import boxes, greedy


def interpolated(flags, n_truths):
    """flags: (tp, fp, score) in rank order -> precision and score at 101 recall points."""
    tp, fp = np.cumsum([f[0] for f in flags]), np.cumsum([f[1] for f in flags])
    prec = tp / np.maximum(tp + fp, 1e-300)
    rec = tp / n_truths
    env = np.maximum.accumulate(prec[::-1])[::-1] if len(prec) else prec
    out, scores = np.zeros(101), np.zeros(101)
    for j in range(101):
        at = np.searchsorted(rec, j * 0.01, side="left")
        if at < len(rec):
            out[j], scores[j] = env[at], flags[at][2]
    return out, scores, (rec[-1] if len(rec) else 0.0)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    p, t = boxes(rng, 160, span=150, big=130), boxes(rng, 90, span=150, big=130)
    t["iscrowd"] = (rng.random(len(t)) < 0.1).astype(np.int32)
    want = {}
    size = (t.x2 - t.x1) * (t.y2 - t.y1)
    for cls in (0, 1):
        for area, (lo, hi) in AREA_RANGES.items():
            n = int(((t.class_id == cls) & (t.iscrowd == 0) & (size >= lo) & (size <= hi)).sum())
            if n == 0:
                continue
            for thr in IOU_THRESHOLDS:
                ranked = []
                for image in range(3):
                    ps = p[(p.image_id == image) & (p.class_id == cls)]
                    flags = greedy(ps, t[(t.image_id == image) & (t.class_id == cls)], thr, area)
                    order = ps.sort_values(["confidence", "det_id"], ascending=[False, True])
                    ranked += [(r.confidence, image, k, *flags[r.det_id]) for k, r in enumerate(order.itertuples())]
                ranked.sort(key=lambda e: (-e[0], e[1], e[2]))
                want[cls, area, thr] = interpolated([(tp, int(not tp and not ig), s) for s, _, _, tp, ig in ranked], n), ranked, n
    return spark.createDataFrame(p), spark.createDataFrame(t), want


def test_precision_table_and_summary(case):
    p, t, want = case
    table, recalls = E.evaluate_detections(p, t, areas=tuple(AREA_RANGES))
    got = table.toPandas()
    assert len(got) == len(want) * 101
    for (cls, area, thr), ((prec, scores, max_rec), _, _) in want.items():
        g = got[(got.class_id == cls) & (got.area_range == area) & np.isclose(got.threshold, thr)].sort_values("recall_no")
        np.testing.assert_allclose(g.precision, prec, atol=1e-12)
        np.testing.assert_allclose(g.max_recall, max_rec, atol=1e-12)
        # scores agree wherever a detection exists at that recall
        np.testing.assert_allclose(g.score, scores, atol=1e-12)
    stats = {r.name: r.value for r in E.summary_statistics(table, recalls).collect()}
    ap = lambda keep: np.mean([w[0][0].mean() for k, w in want.items() if keep(*k)])
    assert abs(stats["AP"] - ap(lambda c, a, t_: a == "all")) < 1e-12
    assert abs(stats["AP75"] - ap(lambda c, a, t_: a == "all" and abs(t_ - 0.75) < 1e-9)) < 1e-12
    assert abs(stats["AP_large"] - ap(lambda c, a, t_: a == "large")) < 1e-12
    first = lambda ranked: sum(e[3] for e in ranked if e[2] < 1)
    ar1 = np.mean([first(w[1]) / w[2] for k, w in want.items() if k[1] == "all"])
    assert abs(stats["AR_1"] - ar1) < 1e-12
    assert abs(stats["AR_100"] - np.mean([w[0][2] for k, w in want.items() if k[1] == "all"])) < 1e-12


def test_class_without_predictions_scores_zero(spark):
    t = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0), (1, 2, 1, 0.0, 0.0, 9.0, 9.0)], "image_id int, det_id int, class_id int, x1 double, y1 double, x2 double, y2 double")
    p = t.filter("class_id = 0").withColumn("confidence", F.lit(0.9))
    table, _ = E.evaluate_detections(p, t, thresholds=(0.5,))
    ap = {r.class_id: r.ap for r in table.groupBy("class_id").agg(F.avg("precision").alias("ap")).collect()}
    assert ap == {0: 1.0, 1: 0.0}


def test_pair_order_correlation(spark):
    rng = np.random.default_rng(2)
    for levels in (4, 1000):
        x, y = rng.integers(0, levels, 120).astype(float), rng.integers(0, levels, 120).astype(float)
        y = np.where(rng.random(120) < 0.5, x, y)
        s = sum(np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(120) for j in range(i))
        ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        n0 = 120 * 119 / 2
        want = s / np.sqrt((n0 - ties(x)) * (n0 - ties(y)))
        got = E.pair_order_correlation(spark.createDataFrame(pd.DataFrame({"p": x, "l": y})), "p", "l").first()[0]
        assert abs(got - want) < 1e-12


def test_matches_feed_report(case):
    p, t, _ = case
    matches = M.greedy_matches(p, t, (0.5, 0.75))
    table = E.precision_table(matches, M.counting_truths(t), (0.5, 0.75))
    report = {r["class"]: r for r in E.class_report(table).collect()}
    assert set(report) == {"0", "1", "all"}
    assert 0 <= report["all"].precision <= 1 and report["0"].recall == report["1"].recall


def test_equal_scores_with_missing_ones(spark):
    """One score for nearly all rows, and null scores first."""
    rows = [(i % 50, i, 0, 0.5 if i % 10 else None, int(i % 3 > 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "image_id int, det_id int, class_id int, confidence double, hit int")
    m = df.select("*", F.col("det_id").alias("det_rank"), F.lit("all").alias("area_range"), F.array("hit").alias("tp"), F.array(F.lit(0)).alias("ignored"))
    truths = spark.createDataFrame([(0, "all", 4000)], "class_id int, area_range string, n_truths long")
    got = [r.precision for r in E.precision_table(m, truths, (0.5,)).orderBy("recall_no").collect()]
    order = sorted(rows, key=lambda r: (r[3] is not None, r[0], r[1]))
    want, _, _ = interpolated([(r[4], 1 - r[4], 0.0) for r in order], 4000)
    np.testing.assert_allclose(got, want, atol=1e-12)
