"""Detector evaluation: precision/recall accumulation, average precision, operating points, losses, correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions.geometry import Box
from fieldlens.operators.decode import sigmoid
from fieldlens.operators.matching import LANES, counting_truths, greedy_matches, match_bits
from fieldlens.operators.running import SLICE_COLUMNS, average_ranks, rising_runs, running_sums, split_slices, value_slices
from fieldlens.schemas import IOU_THRESHOLDS, MAX_DETECTIONS, RECALL_POINTS


# ---- precision and recall ------------------------------------------------------------------------------------------

def _score_slices(df: DataFrame, source: DataFrame | None, ascending: bool) -> tuple[DataFrame, list[Column]]:
    sign = 1 if ascending else -1
    key = lambda d: d.withColumns({"_key": sign * F.col("confidence"), "_tie": -sign * F.col("image_id")})
    return split_slices(key(df), "_key", "_tie", key(source) if source is not None else None)


def cumulative_hits(matches: DataFrame, n_thresholds: int, source: DataFrame | None = None) -> DataFrame:
    """Running true and false positives by falling confidence, per class and area range, one column per threshold.

    All thresholds share one sort; their flags are bits until the rows are shuffled, and ``row`` holds the columns of ``matches``. Rows that
    count at no threshold are left out. ``source`` is the plain prediction table, used for the slice bounds only.
    """
    tp, ig = lambda i: F.get("tp", F.lit(i)), lambda i: F.get("ignored", F.lit(i))
    bits = lambda flag: sum((flag(i).cast("int") * (1 << i) for i in range(n_thresholds)), F.lit(0))
    live = matches.withColumns({
        "_tp": bits(tp), "_fp": bits(lambda i: (1 - tp(i)) * (1 - ig(i))), "_skip": bits(ig)}).filter("(_tp | _fp) <> 0")
    ready, slices = _score_slices(live, source, ascending=False)
    row = F.struct("_key", "_tie", "det_rank", "image_id", "det_id", "confidence", "_skip", "_tp").alias("row")
    placed = ready.select("class_id", "area_range", *SLICE_COLUMNS, "_tp", "_fp", row)
    bit = lambda c, i: F.expr(f"cast((shiftright({c}, {i}) & 1) as bigint)")
    sums = {f"c{kind}{i}": bit(f"_{kind}", i) for i in range(n_thresholds) for kind in ("tp", "fp")}
    return rising_runs(placed, ["class_id", "area_range"], SLICE_COLUMNS, "row", sums)


def _truth_lookup(truth_counts: DataFrame) -> Column:
    """``n_truths`` of a row's class and area range, NULL without truths; the counts are one row."""
    entry = F.struct(F.struct("class_id", "area_range").alias("k"), F.col("n_truths").alias("v"))
    lookup = truth_counts.filter(F.col("class_id").isNotNull()).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return F.try_element_at(lookup.scalar(), F.struct("class_id", "area_range"))


def pr_curve(matches: DataFrame, truth_counts: DataFrame, threshold_no: int = 0) -> DataFrame:
    """Every ranked prediction with running counts, precision, recall and the best precision at or after it."""
    n_truths = _truth_lookup(truth_counts)
    hits = cumulative_hits(matches.filter(n_truths.isNotNull()), threshold_no + 1)
    tp, fp = F.col(f"ctp{threshold_no}"), F.col(f"cfp{threshold_no}")
    ranked = hits.filter(F.expr(f"(shiftright(row._skip, {threshold_no}) & 1) = 0"))
    rows = ranked.withColumns({"ctp": tp, "cfp": fp, "precision": tp / (tp + fp), "recall": tp / n_truths})
    curve = rising_runs(rows, ["class_id", "area_range"], SLICE_COLUMNS, "row", {"envelope": F.col("precision")}, F.max, backward=True)
    return curve.select("class_id", "area_range", "row.image_id", "row.det_id", "row.det_rank", "row.confidence", "ctp", "cfp", "precision", "recall", "envelope")


def _recall_points(recall: np.ndarray) -> np.ndarray:
    """Highest recall point at or below ``recall`` (points are j/100)."""
    j = np.floor(recall * (RECALL_POINTS - 1))
    best = np.where((j + 1) * 0.01 <= recall, j + 1, np.where(j * 0.01 <= recall, j, j - 1))
    return np.minimum(best, RECALL_POINTS - 1).astype("i4")


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by falling confidence, image, rank and id; nulls first."""
    keys = []
    for c in ("det_id", "det_rank", "_tie", "_key"):
        column = rows.column(c).combine_chunks()
        keys += [column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_valid())]
    return rows.take(pa.array(np.lexsort(keys)))


def _segments(rows: pa.Table, lanes: int, before_tp: list, before_fp: list, truths: list) -> dict[str, np.ndarray]:
    """Best precision, best score and count of true positives per lane and recall segment, for one slice of a curve.

    Bit i of ``_tp`` and ``_fp`` belongs to lane i; ``before_*`` are the counts of the earlier slices, ``truths`` those of a lane (None: no curve).
    """
    rows = _in_order(rows)
    tp_bits, fp_bits = (rows.column(c).to_numpy() for c in ("_tp", "_fp"))
    scores = rows.column("confidence").to_numpy().astype(float)
    known = np.asarray(rows.column("confidence").combine_chunks().is_valid())
    parts = []
    for lane in range(lanes):
        at = np.flatnonzero(tp_bits >> lane & 1)
        if truths[lane] is None or not len(at):
            continue
        ctp = before_tp[lane] + np.arange(1, len(at) + 1)
        cfp = before_fp[lane] + np.cumsum(fp_bits >> lane & 1)[at]
        segment = _recall_points(ctp / truths[lane])
        heads = np.flatnonzero(np.diff(segment, prepend=-1))
        score = np.maximum.reduceat(np.where(known[at], scores[at], -np.inf), heads)
        some = np.logical_or.reduceat(known[at], heads)
        parts.append((np.full(len(heads), lane, "i4"), segment[heads], np.maximum.reduceat(ctp / (ctp + cfp), heads), score, some,
                      np.maximum.reduceat(ctp, heads)))
    names = ("lane", "segment", "precision", "score", "_scored", "ctp")
    return dict(zip(names, map(np.concatenate, zip(*parts)))) if parts else {}


def _bit_totals(bits: np.ndarray, lanes: int) -> np.ndarray:
    return np.array([np.count_nonzero(bits >> i & 1) for i in range(lanes)], np.int64)


def _sliced(live: DataFrame, group: Sequence[str], lanes: int, source: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their slice of the score, and the totals of the slices.

    Totals: true and false positives of each lane, and the true ones of the first ``MAX_DETECTIONS`` of an image, lane by lane for each limit.
    Both are read as whole rows by group and slice, so that one shuffle serves all uses.
    """
    group = list(group)
    ready, _ = _score_slices(live, source, ascending=False)
    keys = [*group, *SLICE_COLUMNS]
    placed = ready.select(*keys, F.col("_key").cast("double").alias("_key"), "_tie", "det_rank", "det_id", "confidence", "_tp", "_fp")
    types = dict(placed.dtypes)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        tp, fp, rank = (rows.column(c).to_numpy() for c in ("_tp", "_fp", "det_rank"))
        found = np.concatenate([_bit_totals(tp[rank <= m], lanes) for m in MAX_DETECTIONS])
        sums = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (_bit_totals(tp, lanes), _bit_totals(fp, lanes), found)]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *sums], names=[*keys, "_tp", "_fp", "_found"])

    schema = ", ".join([f"{c} {types[c]}" for c in keys] + [f"{c} array<bigint>" for c in ("_tp", "_fp", "_found")])
    return placed, placed.groupBy(*keys).applyInArrow(count, schema)


def _interpolated(
    placed: DataFrame, totals: DataFrame, group: Sequence[str], lanes: Sequence[tuple[str | None, int]], truth_counts: DataFrame,
    thresholds: Sequence[float], tops: DataFrame,
) -> DataFrame:
    """Precision table of ``_sliced`` rows with the flags of lane i, an (area range, threshold number), in bit i of ``_tp`` and ``_fp``.

    Each slice is sorted and summed as one Arrow table from the totals of the slices before it. ``group`` is the class, and the area range
    unless the lanes name it; ``tops`` holds the predictions of the best score.
    """
    group = list(group)
    keys = [*group, *SLICE_COLUMNS]
    n = len(lanes)
    before = Window.partitionBy(*group).orderBy(*SLICE_COLUMNS).rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))).over(before), F.lit(0)) for i in range(n)]).alias(c)
    entry = F.struct(F.struct("class_id", "area_range").alias("k"), F.col("n_truths").alias("v"))
    lookup = truth_counts.filter(F.col("class_id").isNotNull()).agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
    area = lambda name: F.col("area_range") if name is None else F.lit(name)
    truths = F.array(*[F.try_element_at(F.col("_m"), F.struct(F.col("class_id"), area(name).alias("area_range"))) for name, _ in lanes])
    bases = totals.select(*keys, carried("_tp"), carried("_fp")).withColumn("_m", lookup).select(
        *[F.col(k).alias(f"_of{k}") for k in keys], "_tp", "_fp", truths.alias("_truths"))
    types = dict(placed.dtypes)
    names = ["lane", "segment", "precision", "score", "ctp"]

    def run(key: tuple, rows: pa.Table, base: pa.Table) -> pa.Table:
        found = _segments(rows, n, *(base.column(c)[0].as_py() for c in ("_tp", "_fp", "_truths"))) if rows.num_rows and base.num_rows else {}
        size = len(found.get("lane", ()))
        held = [pa.array([k.as_py()] * size, k.type) for k in key[:len(group)]]
        score = pa.array(found.get("score", np.zeros(0)), mask=~found.get("_scored", np.zeros(0, bool)))
        kinds = {"lane": pa.int32(), "segment": pa.int32(), "precision": pa.float64(), "ctp": pa.int64()}
        return pa.table([*held, *[score if c == "score" else pa.array(found.get(c, np.zeros(0)), kinds[c]) for c in names]], names=[*group, *names])

    schema = ", ".join([f"{c} {types[c]}" for c in group] + ["lane int, segment int, precision double, score double, ctp bigint"])
    points = placed.groupBy(*keys).cogroup(bases.groupBy(*[f"_of{k}" for k in keys])).applyInArrow(run, schema)
    lane_of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("lane"))
    if lanes[0][0] is not None:
        points = points.withColumn("area_range", lane_of([name for name, _ in lanes]))
    points = points.withColumn("thr_no", lane_of([i for _, i in lanes]))
    curve = ["class_id", "area_range", "thr_no"]
    segments = points.groupBy(*curve, "segment").agg(
        F.max("precision").alias("precision"), F.max("score").alias("score"), F.max("ctp").alias("ctp"))
    curves = segments.groupBy(*curve).agg(
        F.collect_list(F.struct("segment", "precision", "score")).alias("s"), F.max("ctp").alias("ctp"))
    top = tops.groupBy(*group).agg(F.max("confidence").alias("top_score"))
    listed_truths = truth_counts.join(top, group, "left").withColumn("thr_no", F.explode(F.array(*[F.lit(i) for i in range(len(thresholds))])))
    full = listed_truths.join(curves, curve, "left")
    beyond = lambda j, field: F.coalesce(F.array_max(F.transform(
        F.filter("s", lambda e: e["segment"] >= j), lambda e: e[field])), F.lit(0.0))
    cells = F.transform(F.sequence(F.lit(0), F.lit(RECALL_POINTS - 1)), lambda j: F.struct(
        j.alias("recall_no"), beyond(j, "precision").alias("precision"),
        F.when(j == 0, F.coalesce("top_score", F.lit(0.0))).otherwise(beyond(j, "score")).alias("score")))
    threshold = F.get(F.array(*[F.lit(t) for t in thresholds]), F.col("thr_no"))
    max_recall = F.coalesce(F.col("ctp"), F.lit(0)) / F.col("n_truths")
    return full.select(*curve, threshold.alias("threshold"), max_recall.alias("max_recall"), F.inline(cells))


def precision_table(
    matches: DataFrame, truth_counts: DataFrame, thresholds: Sequence[float], source: DataFrame | None = None
) -> DataFrame:
    """Interpolated precision and score at every recall point, per class, area range and threshold (at most ``LANES``).

    Interpolated precision at a point is the best precision at or beyond it, so a maximum per recall segment
    (at most 101 per slice of a curve) replaces a second pass over the sorted predictions. ``source`` is the plain prediction table, used for
    the slice bounds only.
    """
    n = len(thresholds)
    if n > LANES:
        raise ValueError(f"at most {LANES} thresholds")
    # By array functions: an expression for each threshold makes methods that the JVM does not compile.
    bits = lambda flags: F.aggregate(F.reverse(F.slice(flags, 1, n)), F.lit(0).cast("bigint"), lambda s, v: s * 2 + v)
    group = ["class_id", "area_range"]
    live = matches.select(*group, "image_id", "det_id", "det_rank", "confidence", bits(F.col("tp")).alias("_tp"),
                          bits(F.zip_with("tp", "ignored", lambda t, i: (1 - t) * (1 - i))).alias("_fp"))
    lanes = [(None, i) for i in range(n)]
    placed, totals = _sliced(live.filter(_truth_lookup(truth_counts).isNotNull()), group, n, source)
    return _interpolated(placed, totals, group, lanes, truth_counts, thresholds, matches)


def recall_by_limit(matches: DataFrame, truth_counts: DataFrame, n_thresholds: int, limits: Sequence[int] = MAX_DETECTIONS) -> DataFrame:
    """Mean recall over thresholds per class and area range when only the first ``limit`` detections count."""
    found = [F.sum(F.when(F.col("det_rank") <= m, F.aggregate("tp", F.lit(0), lambda s, v: s + v))).alias(f"_f{m}") for m in limits]
    sums = matches.groupBy("class_id", "area_range").agg(*found)
    return _recall_shares(truth_counts.join(sums, ["class_id", "area_range"], "left"), n_thresholds, limits)


def _recall_shares(joined: DataFrame, n_thresholds: int, limits: Sequence[int]) -> DataFrame:
    return joined.select("class_id", "area_range", *[
        (F.coalesce(F.col(f"_f{m}"), F.lit(0)) / (F.col("n_truths") * n_thresholds)).alias(f"ar_{m}") for m in limits])


def summary_statistics(table: DataFrame, recalls: DataFrame) -> DataFrame:
    """The twelve summary numbers as (name, value) rows."""
    p, area, thr = F.col("precision"), F.col("area_range"), F.col("threshold")
    mean = lambda cond: F.avg(F.when(cond, p))
    ap = table.agg(
        mean(area == "all").alias("AP"), mean((area == "all") & (thr == 0.5)).alias("AP50"), mean((area == "all") & (thr == 0.75)).alias("AP75"),
        mean(area == "small").alias("AP_small"), mean(area == "medium").alias("AP_medium"), mean(area == "large").alias("AP_large"))
    pick = lambda n, c: F.avg(F.when(area == n, F.col(c)))
    ar = recalls.agg(
        pick("all", "ar_1").alias("AR_1"), pick("all", "ar_10").alias("AR_10"), pick("all", "ar_100").alias("AR_100"),
        pick("small", "ar_100").alias("AR_small"), pick("medium", "ar_100").alias("AR_medium"), pick("large", "ar_100").alias("AR_large"))
    long = lambda d: d.unpivot([], d.columns, "name", "value")
    return long(ap).unionByName(long(ar))


def class_report(table: DataFrame, names: Column | None = None) -> DataFrame:
    """Per class AP, AP50, precision and recall at the recall point of best macro F1, plus an ``all`` row.

    ``table`` is ``precision_table`` output; only the whole area range is used. Classes without truths have no rows.
    """
    whole = table.filter(F.col("area_range") == "all")
    at50 = whole.filter(F.col("threshold") == 0.5)
    recall = F.col("recall_no") * F.lit(0.01)
    f1 = F.try_divide(2 * F.col("precision") * recall, F.col("precision") + recall)
    macro = at50.groupBy("recall_no").agg(F.avg(f1).alias("f1"))
    best = macro.agg(F.max_by("recall_no", F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("recall_no"))).alias("j"))
    here = (F.col("threshold") == 0.5) & (F.col("recall_no") == F.col("_j"))
    marked = whole.crossJoin(F.broadcast(best.select(F.col("j").alias("_j"))))  # one row; in the same plan, so that the shuffles below are made once
    stats = [
        F.avg("precision").alias("ap"), F.avg(F.when(F.col("threshold") == 0.5, F.col("precision"))).alias("ap50"),
        F.avg(F.when(here, F.col("precision"))).alias("precision"), F.max(F.col("_j") * F.lit(0.01)).alias("recall"),
        F.avg(F.when(here, F.col("score"))).alias("score_threshold"),
    ]
    label = names if names is not None else F.col("class_id").cast("string")
    per_class = marked.groupBy("class_id").agg(*stats).withColumn("class", label).drop("class_id")
    return per_class.unionByName(marked.agg(*stats).withColumn("class", F.lit("all")))


def evaluate_detections(
    preds: DataFrame, truths: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS, areas: Sequence[str] = ("all",), max_dets: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(precision table, recall table) of predictions against ground truths.

    Nothing runs while the tables are declared. The flags of all thresholds and area ranges stay in one row per prediction, so predictions are
    ranked once; the match table feeds several aggregates, and within one query its shuffles are reused.
    """
    n = len(thresholds)
    counts = counting_truths(truths, areas)
    if n * len(areas) > LANES:
        matches = greedy_matches(preds, truths, thresholds, areas, max_dets)
        return precision_table(matches, counts, thresholds, preds), recall_by_limit(matches, counts, n)
    matches = match_bits(preds, truths, thresholds, areas, max_dets)
    whole = F.lit((1 << n * len(areas)) - 1)
    live = matches.withColumns({"_tp": F.col("tp"), "_fp": F.bitwise_not(F.col("tp").bitwiseOR(F.col("ignored"))).bitwiseAND(whole)}).filter("(_tp | _fp) <> 0")
    some = counts.filter(F.col("class_id").isNotNull()).agg(F.collect_set("class_id").alias("c")).scalar()
    lanes = [(a, i) for a in areas for i in range(n)]
    placed, totals = _sliced(live.filter(F.array_contains(some, F.col("class_id"))), ["class_id"], len(lanes), preds)
    return _interpolated(placed, totals, ["class_id"], lanes, counts, thresholds, preds), _recalls(totals, counts, areas, n)


def _recalls(totals: DataFrame, truth_counts: DataFrame, areas: Sequence[str], n: int) -> DataFrame:
    """``recall_by_limit`` of the totals of slices."""
    width = len(areas) * n
    found = lambda k, m: F.sum(F.aggregate(F.slice("_found", m * width + k * n + 1, n), F.lit(0).cast("bigint"), lambda s, v: s + v))
    limits = range(len(MAX_DETECTIONS))
    sums = totals.groupBy("class_id").agg(*[found(k, m).alias(f"_f{m}_{k}") for k in range(len(areas)) for m in limits])
    rows = sums.select("class_id", F.inline(F.array(*[
        F.struct(F.lit(a).alias("area_range"), *[F.col(f"_f{m}_{k}").alias(f"_f{MAX_DETECTIONS[m]}") for m in limits]) for k, a in enumerate(areas)])))
    return _recall_shares(truth_counts.join(rows, ["class_id", "area_range"], "left"), n, MAX_DETECTIONS)


# ---- losses over matched rows --------------------------------------------------------------------------------------

def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def focal_loss(x: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(x)
    p_t = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * bce_with_logits(x, target) * F.pow(1 - p_t, F.lit(gamma))


def varifocal_loss(x: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    weight = F.when(target > 0, target).otherwise((1 - alpha) * F.pow(F.abs(sigmoid(x) - target), F.lit(gamma)))
    return bce_with_logits(x, target) * weight


def position_loss(x: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    side = F.when(target > 0, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return side * bce_with_logits(x, target) * F.pow(F.abs(target - sigmoid(x)), F.lit(gamma))


def iou_aware_loss(x: Column, positive: Column, iou: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(x)
    t = F.greatest(F.pow(p, F.lit(alpha)) * F.pow(iou, F.lit(1 - alpha)), F.lit(0.01))
    pos = F.when(positive, t).otherwise(F.lit(0.0))
    neg = F.when(positive, 1 - t).otherwise(F.pow(p, F.lit(gamma)))
    return neg * x - log_sigmoid(x) * (pos + neg)


def classification_losses(rows: DataFrame) -> DataFrame:
    """The four classification losses over (image_id, logit, positive, iou) rows, divided by the number of positives.

    The position-supervised variant scales IoU targets by the best one of the image, found by a grouped maximum.
    """
    target = F.when(F.col("positive"), F.col("iou")).otherwise(F.lit(0.0))
    best = rows.groupBy("image_id").agg(F.max(target).alias("_best"))
    x, hot = F.col("logit"), F.col("positive").cast("double")
    scaled = target / (F.col("_best") + 1e-8)
    n = F.count_if("positive")
    return rows.join(best, "image_id").agg(
        (F.sum(focal_loss(x, hot)) / n).alias("focal"), (F.sum(varifocal_loss(x, target)) / n).alias("varifocal"),
        (F.sum(position_loss(x, scaled)) / n).alias("position"),
        (F.sum(iou_aware_loss(x, F.col("positive"), F.col("iou"))) / n).alias("iou_aware"),
    )


def box_losses(pairs: DataFrame) -> DataFrame:
    """Mean L1 of centre boxes and mean 1 - GIoU over matched boxes (x1..y2 and x1_b..y2_b in units of the image)."""
    a, b = Box.of(), Box.of(suffix="_b")
    l1 = sum((F.abs(p - q) for p, q in zip(G.center_from_corners(a), G.center_from_corners(b))), F.lit(0.0))
    n = F.count(F.lit(1))
    return pairs.agg((F.sum(l1) / n).alias("loss_bbox"), (F.sum(1 - G.generalized_iou(a, b)) / n).alias("loss_giou"))


def orientation_loss(pairs: DataFrame) -> DataFrame:
    """Mean 1 - cosine between predicted direction (cos, sin) and target ``angle``; rows without an angle only count."""
    norm = F.greatest(F.sqrt(F.col("cos") * F.col("cos") + F.col("sin") * F.col("sin")), F.lit(1e-12))
    similarity = (F.col("cos") * F.cos("angle") + F.col("sin") * F.sin("angle")) / norm
    return pairs.agg((F.coalesce(F.sum(1 - similarity), F.lit(0.0)) / (F.count(F.lit(1)) + 1e-6)).alias("loss_orient"))


def cardinality_error(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean over images of |queries whose best class is not the last one - targets|."""
    last = F.size("logits")
    best = F.array_position("logits", F.array_max("logits"))
    found = queries.groupBy("image_id").agg(F.count_if(best != last).alias("found"))
    wanted = targets.groupBy("image_id").agg(F.count(F.lit(1)).alias("wanted"))
    both = found.join(wanted, "image_id", "left")
    return both.agg(F.avg(F.abs(F.col("found") - F.coalesce("wanted", F.lit(0)))).alias("cardinality_error"))


def topk_accuracy(rows: DataFrame, ks: Sequence[int] = (1,)) -> DataFrame:
    """Percent of rows whose ``label`` is among the k best ``logits`` (lower class first on ties)."""
    own = F.get("logits", F.col("label"))
    ahead = F.aggregate(
        F.transform("logits", lambda v, i: ((v > own) | ((v == own) & (i < F.col("label")))).cast("int")), F.lit(0), lambda s, v: s + v)
    ranked = rows.select(ahead.alias("_ahead"))
    shares = {f"acc_{k}": F.avg((F.col("_ahead") < k).cast("double")) * 100 for k in ks}
    return ranked.agg(*[v.alias(k) for k, v in shares.items()], (100 - F.avg((F.col("_ahead") < 1).cast("double")) * 100).alias("class_error"))


# ---- agreement of quality scores -----------------------------------------------------------------------------------

def mean_squared_error(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(pred) - F.col(label), F.lit(2.0))).alias("mse"))


def linear_correlation(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.corr(pred, label).alias("lcc"))


def rank_correlation(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Correlation of average ranks; equal values are collapsed first, so ranks are joined to distinct values."""
    pairs = df.groupBy(pred, label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = pairs.join(average_ranks(df, pred, "_rp"), pred).join(average_ranks(df, label, "_rl"), label)
    n, a, b = F.col("_n"), F.col("_rp"), F.col("_rl")
    s = lambda e: F.sum(n * e)
    moments = ranked.agg(F.sum("_n").alias("n"), s(a).alias("a"), s(b).alias("b"), s(a * a).alias("aa"), s(b * b).alias("bb"), s(a * b).alias("ab"))
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    return moments.select((cov / F.sqrt(va * vb)).alias("srcc"))


def pair_order_correlation(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    Two labels first differ at one bit of their dense ranks. Per bit, rows are grouped by the higher bits; within a
    group, by rising prediction, the rows with the bit clear that came before one with the bit set are concordant
    pairs, the reverse are discordant. That is one running sum over (distinct values x bits) rows.
    """
    ranks = value_ranks(df, label, "_rank")
    points = df.groupBy(pred, label).agg(F.count(F.lit(1)).alias("_n")).join(ranks, label)
    bits = ranks.agg(F.ceil(F.log2(F.max("_rank") + F.lit(1.0))).cast("int").alias("b"))
    levels = points.withColumn("_bits", F.greatest(bits.scalar(), F.lit(1))).select(
        pred, "_n", "_rank", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_level"))
    bit = F.expr("(shiftright(_rank, _level) & 1) <> 0")
    prefix = F.expr("shiftright(_rank, _level + 1)")
    counts = levels.select(pred, "_level", prefix.alias("_prefix"), "_n", bit.alias("_set")).groupBy("_level", "_prefix", pred).agg(
        F.sum(F.when(~F.col("_set"), F.col("_n")).otherwise(0)).alias("_clear"), F.sum(F.when(F.col("_set"), F.col("_n")).otherwise(0)).alias("_setn"))
    ready, slice_of = value_slices(counts, pred)
    d = lambda c: F.col(c).cast("double")  # products of counts leave the range of a long
    run = running_sums(ready, ["_level", "_prefix"], [slice_of], [F.col(pred)], {"_cc": F.col("_clear"), "_cs": F.col("_setn")})
    signed = run.agg(F.coalesce(
        F.sum(d("_setn") * (F.col("_cc") - F.col("_clear")) - d("_clear") * (F.col("_cs") - F.col("_setn"))), F.lit(0.0)).alias("s"))
    ties = lambda c, out: df.groupBy(c).agg(F.count(F.lit(1)).alias("t")).agg(
        F.sum(d("t") * (F.col("t") - 1) / 2).alias(out), F.sum("t").alias("n"))
    a, b = ties(pred, "ta"), ties(label, "tb").drop("n")
    one = a.withColumn("tb", b.scalar()).withColumn("s", signed.scalar())
    all_pairs = d("n") * (F.col("n") - 1) / 2
    return one.select((F.col("s") / F.sqrt((all_pairs - F.col("ta")) * (all_pairs - F.col("tb")))).alias("krocc"))


def value_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Zero-based dense rank of every distinct value."""
    distinct = df.select(column).distinct()
    ready, slice_of = value_slices(distinct, column)
    ranked = running_sums(ready, [], [slice_of], [F.col(column)], {out: F.lit(1).cast("bigint")})
    return ranked.select(column, (F.col(out) - 1).alias(out))
