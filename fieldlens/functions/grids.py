"""Grids, heatmaps and masks stored as flat row-major arrays: map-only column expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.schemas import MOS_CATEGORIES, MOS_MEAN, MOS_STD_LEFT, MOS_STD_RIGHT


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.greatest(as_col(low), F.least(as_col(high), v))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def nth_smallest(a: Column, index: Column) -> Column:
    return F.get(F.sort_array(a), index)


def upper_median(a: Column) -> Column:
    return nth_smallest(a, F.floor(F.size(a) / 2).cast("int"))


def nearest_rank(a: Column, p: float) -> Column:
    """Element at index round((n - 1) * p) of the sorted array, halves away from zero."""
    return nth_smallest(a, F.round((F.size(a) - 1) * F.lit(p), 0).cast("int"))


def grid_statistics(a: Column) -> dict[str, Column]:
    return {"min": F.array_min(a), "max": F.array_max(a), "mean": array_mean(a), "median": upper_median(a)}


def grid_difference(a: Column, b: Column) -> dict[str, Column]:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    larger = F.zip_with(a, b, lambda x, y: F.when(y > x, 1.0).otherwise(0.0))
    return {"l1": array_sum(gaps), "linf": F.array_max(gaps), "n_greater": array_sum(larger).cast("bigint")}


def unit_range(a: Column, low: Column, high: Column) -> Column:
    """Values scaled to [0, 1] between two limits; equal limits are spread by 1e-6."""
    top = F.when(high > low, high).otherwise(low + 1e-6)
    return F.transform(a, lambda v: clamp((v - low) / (top - low), 0.0, 1.0))


def robust_unit_range(a: Column, low: float = 0.02, high: float = 0.98) -> Column:
    return unit_range(a, nearest_rank(a, low), nearest_rank(a, high))


def stretch(v: Column, low: Column, high: Column) -> Column:
    return clamp(F.try_divide(v - low, high - low), 0.0, 1.0)


def whole_percent(a: Column) -> Column:
    """Model grid as whole numbers 0..100: clamp, then drop the fraction."""
    return F.transform(a, lambda v: clamp(v, 0.0, 100.0).cast("int"))


# ---- blur ----------------------------------------------------------------------------------------------------------

def blur_probability(energy: Column, tau: Column, beta: Column, floor: Column) -> Column:
    t = F.greatest(tau, F.lit(1e-12))
    return F.transform(energy, lambda e: F.least(F.lit(1.0), F.pow(t / (e + t), beta) + floor))


def either(a: Column, b: Column) -> Column:
    """Probability that at least one of two independent events holds, cell by cell."""
    return F.zip_with(a, b, lambda x, y: 1 - (1 - x) * (1 - y))


def blur_weight(p: Column, alpha: Column, min_weight: Column) -> Column:
    return clamp(1 - alpha * p, min_weight, 1.0)


# ---- probabilities -------------------------------------------------------------------------------------------------

def softmax(a: Column, temperature: float = 1.0) -> Column:
    peak = F.array_max(a)
    raised = F.transform(a, lambda v: F.exp((v - peak) / F.lit(temperature)))
    return _normalised(raised)


def _normalised(a: Column) -> Column:
    # bind the sum once: a one-element array keeps it from being recomputed per element
    return F.flatten(F.transform(F.array(array_sum(a)), lambda s: F.transform(a, lambda v: v / s)))


def objectness(logits: Column) -> Column:
    """One minus the probability of the last class."""
    return 1 - F.element_at(softmax(logits), -1)


def entropy_confidence(a: Column, temperature: float = 1.0) -> Column:
    entropy = -F.aggregate(softmax(a, temperature), F.lit(0.0), lambda s, p: s + p * F.log(p + 1e-12))
    return 1 - entropy / F.log(F.size(a).cast("double"))


def bilinear(a: Column, n: int, u: Column, v: Column, limit: float | None = None) -> Column:
    """Value of an n x n grid at column ``u`` and row ``v`` (cell units, clamped to [0, limit])."""
    limit = n - 0.001 if limit is None else limit
    uu, vv = clamp(u, 0.0, limit), clamp(v, 0.0, limit)
    x0, y0 = F.floor(uu).cast("int"), F.floor(vv).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(n - 1)), F.least(y0 + 1, F.lit(n - 1))
    dx, dy = uu - x0, vv - y0
    at = lambda y, x: F.get(a, y * n + x)
    top = at(y0, x0) * (1 - dx) + at(y0, x1) * dx
    bottom = at(y1, x0) * (1 - dx) + at(y1, x1) * dx
    return top * (1 - dy) + bottom * dy


# ---- mean opinion scores -------------------------------------------------------------------------------------------

def normalised_mos(score: Column) -> Column:
    low = MOS_MEAN + MOS_MEAN * (score - MOS_MEAN) / (4 * MOS_STD_LEFT)
    high = MOS_MEAN + (100 - MOS_MEAN) * (score - MOS_MEAN) / (4 * MOS_STD_RIGHT)
    return clamp(F.when(score < MOS_MEAN, low).otherwise(high), 0.0, 100.0)


def mos_category(normalised: Column) -> Column:
    names = F.array(*[F.lit(c) for c in MOS_CATEGORIES])
    return F.get(names, F.least(F.floor(normalised / 20), F.lit(len(MOS_CATEGORIES) - 1)).cast("int"))


# ---- images as arrays ----------------------------------------------------------------------------------------------

def half_size(a: Column, width: int, height: int) -> Column:
    """Means of 2x2 blocks; the last row and column repeat when a side is odd."""
    nw, nh = (width + 1) // 2, (height + 1) // 2
    at = lambda y, x: F.get(a, F.least(y, F.lit(height - 1)) * width + F.least(x, F.lit(width - 1)))

    def block(i: Column) -> Column:
        y, x = (F.floor(i / nw) * 2).cast("int"), (i % nw) * 2
        return (at(y, x) + at(y, x + 1) + at(y + 1, x) + at(y + 1, x + 1)) * 0.25

    return F.transform(F.sequence(F.lit(0), F.lit(nw * nh - 1)), block)


def tile_of(position: Column, length: Column | int, n: int) -> Column:
    """Tile number of a row or column when ``length`` is cut at whole positions (i * length) div n."""
    return F.floor(((position + 1) * n - 1) / length).cast("int")


# ---- masks ---------------------------------------------------------------------------------------------------------

def quantised_mask(a: Column) -> Column:
    """Min-max scaled to 0..255; a constant input gives zeros."""
    low, high = F.array_min(a), F.array_max(a)
    scaled = lambda v: clamp(F.round(255 * (v - low) / (high - low), 0), 0.0, 255.0).cast("int")
    return F.transform(a, lambda v: F.when(high - low < 1.1920929e-07, F.lit(0)).otherwise(scaled(v)))


def binary_mask(a: Column, threshold: int = 128) -> Column:
    return F.transform(a, lambda v: (v >= threshold).cast("int"))


def mask_errors(mask: Column, width: Column, height: Column, start_value: Column) -> Column:
    """Message of the first broken rule, NULL for a valid mask."""
    expected = width * height
    bad = lambda v: ~v.isin(0, 1)
    spot = F.get(F.filter(F.transform(mask, lambda v, i: F.when(bad(v), i)), lambda i: i.isNotNull()), F.lit(0))
    text = lambda c: c.cast("string")
    return (
        F.when(F.size(mask) != expected, F.concat(F.lit("expected "), text(expected), F.lit(" cells, found "), text(F.size(mask))))
        .when(~start_value.isin(0, 1), F.lit("the first run stands for neither 0 nor 1"))
        .when(F.exists(mask, bad), F.concat(F.lit("cell "), text(spot), F.lit(" holds "), text(F.get(mask, spot)), F.lit(", which is neither 0 nor 1")))
    )


def run_lengths(mask: Column, start_value: Column | int = 0) -> Column:
    """Alternating run lengths from ``start_value``; the first run is 0 when the mask starts with the other value."""
    start = start_value if isinstance(start_value, Column) else F.lit(start_value)
    n = F.size(mask)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(mask, i) != F.get(mask, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    runs = F.zip_with(ends, starts, lambda e, s: e - s)
    return F.when(F.get(mask, F.lit(0)) == start, runs).otherwise(F.concat(F.array(F.lit(0)), runs))


def mask_from_runs(runs: Column, start_value: Column | int = 0) -> Column:
    start = start_value if isinstance(start_value, Column) else F.lit(start_value)
    return F.flatten(F.transform(runs, lambda r, i: F.array_repeat(((start + i) % 2).cast("int"), r)))


def runs_area(runs: Column, start_value: Column | int = 0) -> Column:
    """Number of set pixels."""
    start = start_value if isinstance(start_value, Column) else F.lit(start_value)
    set_runs = F.filter(runs, lambda r, i: (start + i) % 2 == 1)
    return F.aggregate(set_runs, F.lit(0), lambda s, r: s + r)


def mask_box(mask: Column, width: int) -> Column:
    """Struct (x1, y1, x2, y2) of the set cells, NULL for an empty mask."""
    spots = F.filter(F.transform(mask, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    xs = F.transform(spots, lambda i: i % width)
    row = lambda i: F.floor(i / width).cast("int")
    return F.when(F.size(spots) > 0, F.struct(
        F.array_min(xs).alias("x1"), row(F.get(spots, F.lit(0))).alias("y1"), F.array_max(xs).alias("x2"), row(F.element_at(spots, -1)).alias("y2")))


def smoothed_mask(a: Column, width: int, height: int) -> Column:
    """3x3 whole-number mean, then 0 below 127 and 255 otherwise; the border stays as it is."""
    offsets = [dy * width + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)]

    def cell(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        inside = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        total = sum((F.get(a, i + o) for o in offsets), F.lit(0))
        return F.when(inside, F.when(F.floor(total / 9) < 127, F.lit(0)).otherwise(F.lit(255))).otherwise(v)

    return F.transform(a, cell)


def trimap(a: Column, foreground: int = 240, background: int = 10) -> Column:
    return F.transform(a, lambda v: F.when(v > foreground, F.lit(255)).when(v < background, F.lit(0)).otherwise(F.lit(128)))


def over_background(channel: Column, mask: Column, background: int) -> Column:
    """Channel blended over a plain background by a 0..255 mask, fraction dropped."""
    return F.zip_with(channel, mask, lambda c, m: F.floor(c * (m / 255.0) + background * (1 - m / 255.0)).cast("int"))


def blended(base: Column, top: Column, alpha: float) -> Column:
    a = min(max(alpha, 0.0), 1.0)
    return F.zip_with(base, top, lambda b, t: F.floor((1 - a) * b + a * t).cast("int"))
