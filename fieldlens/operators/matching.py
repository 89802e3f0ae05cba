"""Joins between box tables: overlap pairs, best matches, exclusive greedy matching and 1:1 assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions.geometry import Box
from fieldlens.operators.decode import sigmoid
from fieldlens.operators.running import crowd_test
from fieldlens.operators.selection import top_k
from fieldlens.schemas import AREA_RANGES, IOU_THRESHOLDS

_BOX = ["x1", "y1", "x2", "y2"]


def _tiled(df: DataFrame, x1: str, y1: str, x2: str, y2: str, cell: int) -> DataFrame:
    """One row per (box, tile it touches); boxes without extent in order are left out, they overlap nothing."""
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    proper = df.filter((F.col(x2) >= F.col(x1)) & (F.col(y2) >= F.col(y1)))
    return proper.withColumn("_tx", tiles(x1, x2)).withColumn("_ty", tiles(y1, y2))


def overlap_pairs(
    a: DataFrame, b: DataFrame, on: Sequence[str], min_iou: float = 0.0, inclusive: bool = False, cell: int = 256
) -> DataFrame:
    """Pairs of boxes of ``a`` and ``b`` with equal ``on`` columns and IoU above ``min_iou``.

    Columns of ``b`` other than ``on`` get the suffix ``_b``. The equi keys are ``on`` and a spatial tile, so boxes of
    one crowded image are spread over many join keys and far-apart boxes never meet. A pair is kept only in the tile
    holding the corner of its intersection, which removes repeats without another shuffle.
    """
    on = list(on)
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on])
    left = _tiled(a, *_BOX, cell)
    right = _tiled(right, *[f"{c}_b" for c in _BOX], cell)
    box_a, box_b = Box.of(), Box.of(suffix="_b")
    joined = left.join(right, on + ["_tx", "_ty"])
    home = (F.col("_tx") == F.floor(F.greatest("x1", "x1_b") / cell)) & (F.col("_ty") == F.floor(F.greatest("y1", "y1_b") / cell))
    score = G.iou(box_a, box_b)
    enough = score >= min_iou if inclusive else score > min_iou
    return joined.filter(home & enough).withColumn("iou", score).drop("_tx", "_ty")


def best_matches(
    base: DataFrame, cand: DataFrame, on: Sequence[str], base_id: str, cand_id: str, min_iou: float = 0.0,
    keep: Sequence[str] = (), crowds: DataFrame | None = None,
) -> DataFrame:
    """Every base box with its candidate of highest IoU (lowest ``cand_id`` on ties), IoU 0 when there is none.

    One candidate may serve many base boxes. ``keep`` names candidate columns to carry. The boxes of a group of equal ``on`` columns are gathered
    by one aggregate and compared inside that row; groups that may hold more than ``CROWD`` boxes of a side are compared over tiles instead.
    ``crowds`` may name a cheaper table to count, with at least as many rows of each group as either side.
    """
    on = list(on)
    own = [c for c in base.columns if c not in on]
    double = [F.col(c).cast("double").alias(f"_{c}") for c in _BOX]
    of_base = F.struct(*own).alias("p")
    of_cand = F.struct(F.col(cand_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], *double).alias("t")
    kinds = {**dict(base.select(of_base).dtypes), **dict(cand.select(of_cand).dtypes)}
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    both = base.select(*on, of_base, empty("t")).unionByName(cand.select(*on, empty("p"), of_cand))
    types = dict(both.dtypes)
    same = lambda d: d.withColumns({c: F.col(c).cast(types[c]) for c in on})
    base, cand = same(base), same(cand)
    counted = [same(crowds.select(on))] if crowds is not None else [base.select(on), cand.select(on)]
    many = reduce(Column.__or__, [crowd_test(d, on, CROWD) for d in counted])
    grouped = both.filter(~many).groupBy(*on).agg(F.collect_list("p").alias("p"), F.collect_list("t").alias("t")).filter(F.size("p") > 0)
    of = {**{f"p_{c}": F.col(f"p.{c}") for c in own},
          **{f"t_{c}": F.col(f"t.{c}") for c in ("_id", *[f"_keep_{c}" for c in keep], *[f"_{c}" for c in _BOX])}}
    flat = grouped.select(*on, *[v.alias(k) for k, v in of.items()])
    names = ["match_id", "iou", *[f"match_{c}" for c in keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, chosen, overlap = _best_batch(batch, min_iou, [f"t__keep_{c}" for c in keep])
                take = lambda c: batch.column(c).flatten().take(chosen)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(owner) for c in on], *[batch.column(f"p_{c}").flatten() for c in own], take("t__id"), overlap,
                     *[take(f"t__keep_{c}") for c in keep]], names=[*on, *own, *names])

    of_own, of_keep = dict(base.dtypes), dict(cand.dtypes)
    columns = [(c, types[c]) for c in on] + [(c, of_own[c]) for c in own]
    columns += [("match_id", of_keep[cand_id]), ("iou", "double"), *[(f"match_{c}", of_keep[c]) for c in keep]]
    ordinary = flat.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in columns)).select(*base.columns, *names)
    return ordinary.unionByName(_tiled_best(base.filter(many), cand.filter(many), on, base_id, cand_id, min_iou, keep))


def _best_batch(batch: pa.RecordBatch, min_iou: float, keep: Sequence[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(row, place of the best candidate or null, its IoU or 0) of every base box of rows that hold the boxes of one group each."""
    sizes = lambda c: np.diff(batch.column(c).offsets.to_numpy())
    p_sizes, t_sizes = sizes("p_x1"), sizes("t__x1")
    p, t = _side(batch, "p_"), _side(batch, "t__")
    t["crowd"] = np.zeros(len(t["area"]), bool)
    i, j, overlap = _overlaps(p, t, p_sizes, t_sizes, min_iou)
    above = overlap > min_iou
    i, j, overlap = i[above], j[above], overlap[above]
    last_first = [pc.rank(batch.column(c).flatten(), "descending", null_placement="at_end", tiebreaker="min").to_numpy()[j] for c in reversed(keep)]
    by_id = pc.rank(batch.column("t__id").flatten(), "ascending", null_placement="at_end", tiebreaker="min").to_numpy()[j]
    order = np.lexsort((*last_first, by_id, -overlap, i))
    i, j, overlap = i[order], j[order], overlap[order]
    heads = np.flatnonzero(np.diff(i, prepend=-1))
    chosen, best = np.full(len(p["area"]), -1), np.zeros(len(p["area"]))
    chosen[i[heads]], best[i[heads]] = j[heads], overlap[heads]
    return pa.array(np.repeat(np.arange(batch.num_rows), p_sizes)), pa.array(chosen, mask=chosen < 0), pa.array(best)


def _tiled_best(base: DataFrame, cand: DataFrame, on: list[str], base_id: str, cand_id: str, min_iou: float, keep: Sequence[str]) -> DataFrame:
    """``best_matches`` by a join over tiles. The best pair is an aggregate with map-side combine, so a crowded image shuffles one row per
    base box and task."""
    cand = cand.select(*on, cand_id, *_BOX, *keep)
    pairs = overlap_pairs(base.select(*on, base_id, *_BOX), cand, on, min_iou)
    carried = [F.col(f"{c}_b").alias(c) for c in keep]
    best = pairs.groupBy(*on, base_id).agg(
        F.max(F.struct("iou", (-F.col(f"{cand_id}_b")).alias("neg_id"), *carried)).alias("_best")
    )
    return base.join(best, on + [base_id], "left").select(
        *base.columns, (-F.col("_best.neg_id")).alias("match_id"), F.coalesce("_best.iou", F.lit(0.0)).alias("iou"),
        *[F.col(f"_best.{c}").alias(f"match_{c}") for c in keep],
    )


def accepted_matches(pred: DataFrame, truth: DataFrame, on, pred_id: str, truth_id: str, min_iou: float = 0.1, keep=(), crowds=None):
    """(matched, unmatched) predictions: accepted when the best IoU is above ``min_iou``."""
    scored = best_matches(pred, truth, on, pred_id, truth_id, min_iou, keep, crowds)
    return scored.filter(F.col("match_id").isNotNull()), scored.filter(F.col("match_id").isNull()).select(*pred.columns)


# ---- exclusive greedy matching -------------------------------------------------------------------------------------

LANES = 62  # most (area range, threshold) pairs whose flags share one long
CROWD = 4_096  # ground truths of an image whose boxes are compared in one row; images that may hold more are spread by tiles


def greedy_matches(
    preds: DataFrame,
    truths: DataFrame,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    areas: Sequence[str] = ("all",),
    max_dets: int = 100,
) -> DataFrame:
    """Greedy matching of predictions to ground truths per image and class, for every IoU threshold and area range.

    Input columns: image_id, class_id, det_id, x1..y2 (+ confidence for ``preds``, optional iscrowd for ``truths``).
    Predictions take part in order of confidence, the best ``max_dets`` per image and class. Each takes the free ground
    truth of highest IoU at or above the threshold, the higher id on equal IoU; a ground truth that does not count
    (crowd, or area outside the range) is taken only when no counting one is left, and a crowd can be taken repeatedly.
    Overlap with a crowd is measured against the area of the prediction alone.

    Output: one row per (prediction, area range) with ``tp`` and ``ignored`` arrays over the thresholds.
    """
    n = len(thresholds)
    if len(areas) * n > LANES:
        return _tiled_matches(_ranked(preds, max_dets), _with_crowd(truths), thresholds, areas, max_dets)
    packed = match_bits(preds, truths, thresholds, areas, max_dets)
    flags = lambda name, k: F.array(*[F.shiftright(name, k * n + i).bitwiseAND(F.lit(1)).cast("int") for i in range(n)]).alias(name)
    per_area = [F.struct(F.lit(a).alias("area_range"), flags("tp", k), flags("ignored", k)) for k, a in enumerate(areas)]
    return packed.select("image_id", "class_id", "det_id", "det_rank", "confidence", F.inline(F.array(*per_area)))


def match_bits(
    preds: DataFrame, truths: DataFrame, thresholds: Sequence[float] = IOU_THRESHOLDS, areas: Sequence[str] = ("all",), max_dets: int = 100,
) -> DataFrame:
    """``greedy_matches`` as one row per prediction: ``tp`` and ``ignored`` hold bit k * len(thresholds) + i for area range k and threshold i.

    The boxes of an image and class are gathered by one aggregate and matched inside that row. Images that may hold more than ``CROWD``
    ground truths (told by a count of hash buckets) are matched over tiles instead.
    """
    if len(areas) * len(thresholds) > LANES:
        raise ValueError(f"at most {LANES} pairs of area range and threshold")
    on = ["image_id", "class_id"]
    ranked, truths = _ranked(preds, max_dets), _with_crowd(truths)
    double = [F.col(c).cast("double").alias(c) for c in _BOX]
    found = F.struct("det_rank", "det_id", F.col("confidence"), *double)
    truth = F.struct(F.col("det_id").cast("bigint").alias("gt_id"), F.col("iscrowd").cast("int").alias("crowd"), *double)
    kinds, of_truths = dict(ranked.select("det_id", "confidence", found.alias("p")).dtypes), dict(truths.select(truth.alias("t")).dtypes)
    of_preds = ranked.select(*on, found.alias("p"), F.lit(None).cast(of_truths["t"]).alias("t"))
    both = of_preds.unionByName(truths.select(*on, F.lit(None).cast(kinds["p"]).alias("p"), truth.alias("t")))
    same = lambda d: d.withColumn("image_id", F.col("image_id").cast(dict(both.dtypes)["image_id"]))
    crowded = crowd_test(same(truths.select("image_id")), ["image_id"], CROWD)
    grouped = both.filter(~crowded).groupBy(*on).agg(F.collect_list("p").alias("p"), F.collect_list("t").alias("t")).filter(F.size("p") > 0)
    flat = grouped.select(*on, *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("det_rank", "det_id", "confidence", *_BOX)],
                          *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("gt_id", "crowd", *_BOX)])
    ranges = [AREA_RANGES[n] for n in areas]
    levels = [float(t) for t in thresholds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, tp, ignored = _greedy_batch(batch, levels, ranges)
                rank, ids, confidence = (batch.column(f"p_{c}").flatten() for c in ("det_rank", "det_id", "confidence"))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(owner)) for c in on], ids, rank, confidence, pa.array(tp), pa.array(ignored)],
                                                 names=[*on, "det_id", "det_rank", "confidence", "tp", "ignored"])

    types = {**dict(both.dtypes), **kinds}
    schema = ", ".join([f"{c} {types[c]}" for c in (*on, "det_id")] + ["det_rank int", f"confidence {types['confidence']}", "tp bigint", "ignored bigint"])
    ordinary = flat.mapInArrow(run, schema)
    n = len(thresholds)
    long = _tiled_matches(same(ranked).filter(crowded), same(truths).filter(crowded), thresholds, areas, max_dets)
    bits = lambda name, k: sum((F.get(name, F.lit(i)).cast("bigint") * F.lit(1 << (k * n + i)) for i in range(n)), F.lit(0).cast("bigint"))
    packed = lambda name: F.bit_or(reduce(lambda rest, k: F.when(F.col("area_range") == areas[k], bits(name, k)).otherwise(rest), range(len(areas)), F.lit(0).cast("bigint"))).alias(name)
    spread = long.groupBy(*on, "det_rank").agg(F.first("det_id").alias("det_id"), F.first("confidence").alias("confidence"), packed("tp"), packed("ignored"))
    return ordinary.unionByName(spread)


def _ranked(preds: DataFrame, max_dets: int) -> DataFrame:
    return top_k(preds, ["image_id", "class_id"], [F.col("confidence").desc(), F.col("det_id")], max_dets, rank="det_rank")


def _with_crowd(truths: DataFrame) -> DataFrame:
    return truths if "iscrowd" in truths.columns else truths.withColumn("iscrowd", F.lit(0))


_PAIRS = 1_000_000  # pairs of boxes compared at a time


def _side(batch: pa.RecordBatch, prefix: str) -> dict[str, np.ndarray]:
    """Corners of the boxes of one side of all rows, whether they are in order, and areas."""
    d = {c: batch.column(f"{prefix}{c}").flatten().to_numpy(zero_copy_only=False).astype(float) for c in _BOX}
    d["proper"] = (d["x2"] >= d["x1"]) & (d["y2"] >= d["y1"])
    d["area"] = (d["x2"] - d["x1"]) * (d["y2"] - d["y1"])
    return d


def _overlaps(p: dict, t: dict, p_sizes: np.ndarray, t_sizes: np.ndarray, lowest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, truth, overlap) of the pairs of each problem with overlap at or above ``lowest``; numbers are places in the batch."""
    p_ends, t_starts = np.cumsum(p_sizes), np.cumsum(t_sizes) - t_sizes
    partners, first = np.repeat(t_sizes, p_sizes), np.repeat(t_starts, p_sizes)
    ends, found = np.cumsum(partners), []
    at = 0
    while at < len(partners):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        count = partners[at:upto]
        i = np.repeat(np.arange(at, upto), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at:upto], count)
        w = np.minimum(p["x2"][i], t["x2"][j]) - np.maximum(p["x1"][i], t["x1"][j])
        h = np.minimum(p["y2"][i], t["y2"][j]) - np.maximum(p["y1"][i], t["y1"][j])
        inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        whole = p["area"][i] + t["area"][j] - inter
        near = p["proper"][i] & t["proper"][j] & (inter > 0) & (whole > 0)
        i, j, inter, whole = i[near], j[near], inter[near], whole[near]
        overlap = inter / np.where(t["crowd"][j], p["area"][i], whole)
        enough = overlap >= lowest
        found.append((i[enough], j[enough], overlap[enough]))
        at = upto
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found))


def _greedy_batch(batch: pa.RecordBatch, thresholds: Sequence[float], ranges: Sequence[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tp bits, ignored bits) of every prediction of rows that hold the boxes of one problem each, all problems of the batch at once."""
    sizes = lambda c: np.diff(batch.column(c).offsets.to_numpy())
    p_sizes, t_sizes = sizes("p_det_rank"), sizes("t_gt_id")

    p, t = _side(batch, "p_"), _side(batch, "t_")
    rank = batch.column("p_det_rank").flatten().to_numpy(zero_copy_only=False)
    t["crowd"] = batch.column("t_crowd").flatten().fill_null(0).to_numpy(zero_copy_only=False) == 1
    gt = batch.column("t_gt_id").flatten().fill_null(0).to_numpy(zero_copy_only=False)
    place, distinct = _places(np.repeat(np.arange(batch.num_rows), t_sizes), gt, batch.num_rows)
    code = place + np.repeat(np.cumsum(distinct) - distinct, t_sizes)  # equal ids of a problem are one ground truth
    levels = np.array(thresholds)
    n = len(levels)
    i, j, overlap = _overlaps(p, t, p_sizes, t_sizes, levels.min())
    lane = np.left_shift(np.int64(1), np.arange(n))
    tp, ignored = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for k, (lo, hi) in enumerate(ranges):
        off = t["crowd"] | (t["area"] < lo) | (t["area"] > hi)
        order = np.lexsort((t["crowd"][j], -gt[j], -overlap, off[j], i, rank[i]))
        a, b, v = i[order], j[order], overlap[order]
        taken = np.zeros((int(distinct.sum()), n), bool)
        hit, skipped = np.zeros((len(rank), n), bool), np.zeros((len(rank), n), bool)
        skipped[(p["area"] < lo) | (p["area"] > hi)] = True
        cuts = np.flatnonzero(np.diff(rank[a], prepend=-1))
        for start, stop in zip(cuts, [*cuts[1:], len(a)]):
            rows = slice(start, stop)
            free = (v[rows, None] >= levels) & (t["crowd"][b[rows], None] | ~taken[code[b[rows]]])
            heads = np.flatnonzero(np.diff(a[rows], prepend=-1))
            first = np.minimum.reduceat(np.where(free, np.arange(stop - start)[:, None], stop), heads, axis=0)
            d, l = np.nonzero(first < stop)
            truth, pred = b[rows][first[d, l]], a[rows][heads][d]
            taken[code[truth], l] = True
            hit[pred, l], skipped[pred, l] = ~off[truth], off[truth]
        tp |= (hit * lane).sum(axis=1) << (k * n)
        ignored |= (skipped * lane).sum(axis=1) << (k * n)
    return np.repeat(np.arange(batch.num_rows), p_sizes), tp, ignored


def _tiled_matches(ranked: DataFrame, truths: DataFrame, thresholds: Sequence[float], areas: Sequence[str], max_dets: int) -> DataFrame:
    """``greedy_matches`` of ranked predictions over joins by tile.

    A prediction can be refused at most ``max_dets - 1`` ground truths by others, so its ``max_dets`` best ones per
    kind are always enough; that bounds every group whatever the number of ground truths in an image.
    """
    lowest = min(thresholds)
    on = ["image_id", "class_id"]
    pairs = overlap_pairs(
        ranked.select(*on, "det_id", "det_rank", *_BOX), truths.select(*on, F.col("det_id").alias("gt_id"), "iscrowd", *_BOX), on
    )
    inter = G.intersection(Box.of(), Box.of(suffix="_b"))
    overlap = F.when(F.col("iscrowd_b") == 1, F.try_divide(inter, G.area(Box.of()))).otherwise(F.col("iou"))
    pairs = pairs.withColumn("iou", overlap).filter(F.col("iou") >= lowest)
    gt_area, det_area = G.area(Box.of(suffix="_b")), G.area(Box.of())
    outside = lambda size, lo, hi: (size < lo) | (size > hi)
    flags = {
        n: ((F.col("iscrowd_b") == 1) | outside(gt_area, *AREA_RANGES[n])).cast("int").alias(n) for n in areas
    }
    kind = F.struct(F.col("iscrowd_b").alias("crowd"), *flags.values())
    cands = pairs.select(*on, "det_id", "det_rank", F.col("gt_id_b").alias("gt_id"), "iou", kind.alias("kind"))
    cands = top_k(cands, [*on, "det_id", "kind"], [F.col("iou").desc(), F.col("gt_id").desc()], max_dets)
    per_area = F.explode(F.array(*[F.struct(F.lit(n).alias("area_range"), F.col(f"kind.{n}").alias("gt_ignored")) for n in areas]))
    long = cands.select("*", per_area.alias("_a")).select(
        *on, F.col("_a.area_range").alias("area_range"),
        F.struct(
            "det_rank", F.col("_a.gt_ignored").alias("gt_ignored"), (-F.col("iou")).alias("neg_iou"),
            (-F.col("gt_id")).cast("bigint").alias("neg_gt"), F.col("kind.crowd").alias("crowd"),
        ).alias("c"),
    )
    thresholds_sql = "array(" + ",".join(f"{t}D" for t in thresholds) + ")"
    fold = f"""
      flatten(transform({thresholds_sql}, (t, i) -> aggregate(
        filter(cands, c -> -c.neg_iou >= t),
        named_struct('taken', cast(array() as array<bigint>), 'last', 0,
                     'hits', cast(array() as array<struct<det_rank:int,thr:int,gt_ignored:int>>)),
        (s, c) -> if(c.det_rank = s.last or (c.crowd = 0 and array_contains(s.taken, c.neg_gt)), s,
          named_struct('taken', array_append(s.taken, c.neg_gt), 'last', c.det_rank,
                       'hits', array_append(s.hits, named_struct('det_rank', c.det_rank, 'thr', i, 'gt_ignored', c.gt_ignored)))),
        s -> s.hits)))"""
    hits = (
        long.groupBy(*on, "area_range").agg(F.sort_array(F.collect_list("c")).alias("cands"))
        .select(*on, "area_range", F.inline(F.expr(fold)))
        .groupBy(*on, "area_range", "det_rank")
        .agg(*[F.max(F.when(F.col("thr") == i, F.col("gt_ignored"))).alias(f"_h{i}") for i in range(len(thresholds))])
    )
    names = F.explode(F.array(*[F.lit(n) for n in areas]))
    rows = ranked.select(*on, "det_id", "det_rank", "confidence", det_area.alias("_size"), names.alias("area_range"))
    matched = rows.join(hits, [*on, "area_range", "det_rank"], "left")
    size_out = F.lit(False)
    for n in areas:
        size_out = size_out | ((F.col("area_range") == n) & outside(F.col("_size"), *AREA_RANGES[n]))
    hit = [F.col(f"_h{i}") for i in range(len(thresholds))]
    return matched.select(
        *on, "det_id", "det_rank", "confidence", "area_range",
        F.array(*[F.coalesce((h == 0).cast("int"), F.lit(0)) for h in hit]).alias("tp"),
        F.array(*[F.coalesce(h, size_out.cast("int")) for h in hit]).alias("ignored"),
    )


def counting_truths(truths: DataFrame, areas: Sequence[str] = ("all",)) -> DataFrame:
    """Number of ground truths that count, per class and area range."""
    if "iscrowd" not in truths.columns:
        truths = truths.withColumn("iscrowd", F.lit(0))
    size = G.area(Box.of())
    inside = F.array_compact(F.array(*[
        F.when((F.col("iscrowd") == 0) & size.between(*AREA_RANGES[n]), F.lit(n)) for n in areas
    ]))
    return truths.select("class_id", F.explode(inside).alias("area_range")).groupBy("class_id", "area_range").agg(
        F.count(F.lit(1)).alias("n_truths")
    )


# ---- minimum-cost assignment ---------------------------------------------------------------------------------------

def focal_class_cost(p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    negative = (1 - alpha) * F.pow(p, F.lit(gamma)) * (-F.log(1 - p + 1e-8))
    positive = alpha * F.pow(1 - p, F.lit(gamma)) * (-F.log(p + 1e-8))
    return positive - negative


def match_costs(
    queries: DataFrame, targets: DataFrame, class_weight: float = 1.0, box_weight: float = 1.0, giou_weight: float = 1.0,
    keep: Sequence[str] = (), block: int | None = None,
) -> DataFrame:
    """Cost of every (query, target) of an image: class + L1 of centre boxes - generalised IoU.

    ``queries``: image_id, query_id, logits (array over classes), x1..y2 in units of the image. ``targets``: image_id,
    target_id, class_id, x1..y2. ``keep`` names query columns to carry, such as the query group. With ``block`` the targets of
    an image are dealt into blocks of about that many, each a join key of its own that all queries of the image visit, so a
    crowded image is spread over many tasks.
    """
    on = ["image_id"]
    t = targets.select("image_id", "target_id", "class_id", *[F.col(c).alias(f"{c}_b") for c in _BOX])
    if block:
        blocks = targets.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
        t = t.join(blocks, "image_id").withColumn("_block", F.pmod(F.xxhash64("target_id"), F.col("_blocks")).cast("int")).drop("_blocks")
        visits = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        queries = queries.join(blocks, "image_id").withColumn("_block", visits).drop("_blocks")
        on.append("_block")
    pairs = queries.join(t, on)
    a, b = Box.of(), Box.of(suffix="_b")
    l1 = sum((F.abs(p - q) for p, q in zip(G.center_from_corners(a), G.center_from_corners(b))), F.lit(0.0))
    prob = sigmoid(F.get("logits", F.col("class_id")))
    cost = class_weight * focal_class_cost(prob) + box_weight * l1 - giou_weight * G.generalized_iou(a, b)
    return pairs.select("image_id", *keep, "query_id", "target_id", cost.alias("cost"))


def _assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost assignment (shortest augmenting paths, rows <= columns)."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = _assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        base = 0.0
        while True:
            reduced = base + cost[row] - u[row] - v
            better = ~done & (reduced < dist)
            dist[better], came[better] = reduced[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[col] = dist[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        settled = done & (owner >= 0)
        u[owner[settled]] += base - dist[settled]
        v[done] -= base - dist[done]
        u[start] += base
        while col >= 0:
            prev = came[col]
            owner[col] = start if prev < 0 else owner[prev]
            col = prev
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def _assign_many(costs: np.ndarray) -> np.ndarray:
    """Columns of minimum-cost assignments of many problems of one shape, rows <= columns: ``costs`` is (problems, n, m), the result (problems, n).

    The steps of ``_assign`` for all problems at once; a problem that found its free column waits for the others.
    """
    count, n, m = costs.shape
    every = np.arange(count)
    u, v = np.zeros((count, n)), np.zeros((count, m))
    owner = np.full((count, m), -1)
    for start in range(n):
        dist, came, done = np.full((count, m), np.inf), np.full((count, m), -1), np.zeros((count, m), bool)
        row, col, base, last = np.full(count, start), np.full(count, -1), np.zeros(count), np.full(count, -1)
        at = every
        while len(at):
            reduced = base[at, None] + costs[at, row[at]] - u[at, row[at]][:, None] - v[at]
            better = ~done[at] & (reduced < dist[at])
            dist[at] = np.where(better, reduced, dist[at])
            came[at] = np.where(better, col[at][:, None], came[at])
            best = np.argmin(np.where(done[at], np.inf, dist[at]), axis=1)
            col[at], base[at] = best, dist[at, best]
            done[at, best] = True
            taken = owner[at, best]
            last[at[taken < 0]] = best[taken < 0]
            at, taken = at[taken >= 0], taken[taken >= 0]
            row[at] = taken
        which, settled = np.nonzero(done & (owner >= 0))
        u[which, owner[which, settled]] += base[which] - dist[which, settled]
        which, reached = np.nonzero(done)
        v[which, reached] -= base[which] - dist[which, reached]
        u[:, start] += base
        at = every
        while len(at):
            here = last[at]
            prev = came[at, here]
            owner[at, here] = np.where(prev < 0, start, owner[at, prev])
            last[at] = prev
            at = at[prev >= 0]
    cols = np.empty((count, n), int)
    which, reached = np.nonzero(owner >= 0)
    cols[which, owner[which, reached]] = reached
    return cols


def _places(problem: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of every id among the distinct ids of its problem, and how many those are per problem."""
    order = np.lexsort((ids, problem))
    p, i = problem[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    sizes = np.bincount(p[new], minlength=count)
    place = np.empty(len(order), int)
    place[order] = np.cumsum(new) - 1 - (np.cumsum(sizes) - sizes)[p]
    return place, sizes


def _solved(problem: np.ndarray, q: np.ndarray, t: np.ndarray, cost: np.ndarray, count: int) -> np.ndarray:
    """Indices of the chosen rows; the problems of one shape are solved together, up to 2,000,000 costs at a time."""
    qi, n = _places(problem, q, count)
    ti, m = _places(problem, t, count)
    turned = n > m
    a, b = np.where(turned[problem], ti, qi), np.where(turned[problem], qi, ti)
    few, many = np.minimum(n, m), np.maximum(n, m)
    chosen = []
    by_problem = np.argsort(problem, kind="stable")
    ends = np.cumsum(np.bincount(problem, minlength=count))
    for rows, cols in np.unique(np.stack([few, many], axis=1), axis=0):
        same = np.flatnonzero((few == rows) & (many == cols))
        step = max(1, 2_000_000 // max(1, int(rows * cols)))
        for part in (same[i:i + step] for i in range(0, len(same), step)):
            lengths = ends[part] - np.concatenate([[0], ends])[part]
            local = np.repeat(np.arange(len(part)), lengths)
            offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = by_problem[np.concatenate([[0], ends])[part][local] + offset]
            matrix, where = np.full((len(part), rows, cols), 1e12), np.full((len(part), rows, cols), -1)
            matrix[local, a[at], b[at]], where[local, a[at], b[at]] = cost[at], at
            if len(part) == 1:
                r, c = _assign(matrix[0])
                chosen.append(where[0, r, c])
            else:
                chosen.append(np.take_along_axis(where, _assign_many(matrix)[:, :, None], 2).ravel())
    found = np.concatenate(chosen) if chosen else np.zeros(0, int)
    return found[found >= 0]


def assign_targets(costs: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Minimum-cost 1:1 assignment per problem (equal ``by`` columns, whole numbers) over ``match_costs`` rows.

    Every query of a problem gets a target, or every target a query if there are fewer targets. A problem with n queries and m targets needs, of
    the smaller side, only the min(n, m) cheapest partners of each, since the others can take at most one less; so a task holds
    min(n, m)^2 costs however many there are on the other side.
    """
    by = list(by)
    kinds = dict(costs.dtypes)
    sides = costs.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("_m")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_m"))
    sized = costs.join(sides, by)
    few = F.when(F.col("_n") <= F.col("_m"), F.struct(F.col("query_id").cast("bigint").alias("a"), F.col("target_id").cast("bigint").alias("b"))).otherwise(
        F.struct(F.col("target_id").cast("bigint").alias("a"), F.col("query_id").cast("bigint").alias("b")))
    own = sized.select(*by, "query_id", "target_id", "cost", few.alias("_f"), F.least("_n", "_m").alias("_k")).select("*", F.col("_f.a").alias("_a"))
    cheapest = F.row_number().over(Window.partitionBy(*by, "_a").orderBy("cost", "_f.b"))
    needed = own.withColumn("_r", cheapest).filter("_r <= _k").select(*by, "query_id", "target_id", "cost")
    grouped = needed.groupBy(*by).agg(F.collect_list(F.struct("query_id", "target_id", "cost")).alias("c"))
    flat = grouped.select(*by, F.col("c.query_id").alias("q"), F.col("c.target_id").alias("t"), F.col("c.cost").alias("cost"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("q", "t", "cost")]
            problem = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy())
            q, t, cost = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            at = _solved(problem, q, t, cost, batch.num_rows)
            owner = pa.array(problem[at])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(owner) for c in by], *[pa.array(x[at]) for x in (q, t, cost)]], names=[*by, "query_id", "target_id", "cost"])

    columns = ", ".join(f"{c} {kinds[c]}" for c in (*by, "query_id", "target_id"))
    return flat.mapInArrow(solve, f"{columns}, cost double")


def assign_query_groups(queries: DataFrame, targets: DataFrame, group: str = "query_group", block: int = 512, **weights: float) -> DataFrame:
    """Assignment of the targets of an image to each of its query groups alone: every group sees all targets.

    Rows (image_id, group, query_id, target_id, cost). Queries of a group number the fewer or the more; an image without targets, or
    without queries, has no rows.
    """
    costs = match_costs(queries, targets, keep=[group], block=block, **weights)
    return assign_targets(costs, ["image_id", group])
