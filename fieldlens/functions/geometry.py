"""Bounding boxes and angles as pure column expressions."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}{suffix}") for c in cls._fields])

    def named(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}{suffix}") for n, c in zip(self._fields, self)]

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1


def _between(value: Column, low, high) -> Column:
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.greatest(low, F.least(high, value))


def corners_from_center(cx: Column, cy: Column, w: Column, h: Column, clamp: bool = True) -> Box:
    """Corners of a centre-form box; ``clamp`` treats negative sizes as zero."""
    if clamp:
        w, h = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def center_from_corners(b: Box) -> tuple[Column, Column, Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.width, b.height


def corner_size(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.width, b.height


def corners_from_size(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def scaled(b: Box, sx: Column, sy: Column) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def normalised(b: Box, width: Column, height: Column) -> Box:
    return Box(b.x1 / width, b.y1 / height, b.x2 / width, b.y2 / height)


def unit_center_box(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Centre form in units of the image: x by width, y by height."""
    return center_from_corners(normalised(b, width, height))


def clipped(b: Box, width: Column, height: Column) -> Box:
    w, h = width.cast("double"), height.cast("double")
    return Box(_between(b.x1, 0.0, w), _between(b.y1, 0.0, h), _between(b.x2, 0.0, w), _between(b.y2, 0.0, h))


def annotation_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Annotation clamp: the corner stays inside the image, sizes are at least 1, the area follows the clamp."""
    cx = _between(x, 0.0, (width - 1).cast("double"))
    cy = _between(y, 0.0, (height - 1).cast("double"))
    cw = F.greatest(F.lit(1.0), F.least(w, width - cx))
    ch = F.greatest(F.lit(1.0), F.least(h, height - cy))
    return {"x": cx, "y": cy, "w": cw, "h": ch, "area": cw * ch}


def is_proper(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)


def area(b: Box) -> Column:
    return b.width * b.height


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box, kind: str = "zero") -> Column:
    """Intersection over union. ``ratio``: 0/0 is NULL. ``zero``: 0 without overlap or without area.
    ``strict``: as ``zero``, and boxes that only touch do not overlap."""
    inter, uni = intersection(a, b), union(a, b)
    if kind == "ratio":
        return F.try_divide(inter, uni)
    if kind == "strict":
        apart = (F.least(a.x2, b.x2) <= F.greatest(a.x1, b.x1)) | (F.least(a.y2, b.y2) <= F.greatest(a.y1, b.y1))
    else:
        apart = (F.least(a.x2, b.x2) < F.greatest(a.x1, b.x1)) | (F.least(a.y2, b.y2) < F.greatest(a.y1, b.y1))
    return F.when(apart | (uni <= 0), F.lit(0.0)).otherwise(F.try_divide(inter, uni))


def generalized_iou(a: Box, b: Box) -> Column:
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    return iou(a, b, "ratio") - F.try_divide(hull - union(a, b), hull)


def square_crop(df: DataFrame, b: Box, width: str, height: str, padding: float = 0.1) -> DataFrame:
    """Add the square pixel window ``crop_x1..crop_y2`` around a box, in whole pixels inside the image."""
    w, h, i = F.col(width), F.col(height), lambda c: c.cast("int")
    nonneg = lambda c: F.greatest(F.lit(0), c)
    half = lambda c: (c / 2).cast("int")
    corner = df.withColumns({
        "_x1": i(F.greatest(F.lit(0.0), b.x1)), "_y1": i(F.greatest(F.lit(0.0), b.y1)),
        "_x2": i(F.least(w.cast("double"), b.x2)), "_y2": i(F.least(h.cast("double"), b.y2)),
    })
    c = F.col
    padded = corner.withColumns({
        "_px": i((c("_x2") - c("_x1")) * F.lit(padding)), "_py": i((c("_y2") - c("_y1")) * F.lit(padding)),
    }).withColumns({
        "_ex1": nonneg(c("_x1") - c("_px")), "_ey1": nonneg(c("_y1") - c("_py")),
        "_ex2": F.least(w, c("_x2") + c("_px")), "_ey2": F.least(h, c("_y2") + c("_py")),
    }).withColumns({
        "_cx": half(c("_ex1") + c("_ex2")), "_cy": half(c("_ey1") + c("_ey2")),
        "_half": half(F.greatest(c("_ex2") - c("_ex1"), c("_ey2") - c("_ey1"))),
    }).withColumns({
        "_qx1": nonneg(c("_cx") - c("_half")), "_qy1": nonneg(c("_cy") - c("_half")),
        "_qx2": F.least(w, c("_cx") + c("_half")), "_qy2": F.least(h, c("_cy") + c("_half")),
    }).withColumns({
        "_gx": half(nonneg((c("_qy2") - c("_qy1")) - (c("_qx2") - c("_qx1")))),
        "_gy": half(nonneg((c("_qx2") - c("_qx1")) - (c("_qy2") - c("_qy1")))),
    }).withColumns({
        "crop_x1": nonneg(c("_qx1") - c("_gx")), "crop_y1": nonneg(c("_qy1") - c("_gy")),
        "crop_x2": F.least(w, c("_qx2") + c("_gx")), "crop_y2": F.least(h, c("_qy2") + c("_gy")),
    })
    return padded.select(*df.columns, "crop_x1", "crop_y1", "crop_x2", "crop_y2")


def size_prior(b: Box, width: Column, height: Column, reference: float = 96.0) -> Column:
    """Shorter side in whole pixels of the clipped box, over the reference size, in [0, 1]."""
    c = clipped(b, width, height)
    side = F.least(c.x2.cast("int") - c.x1.cast("int"), c.y2.cast("int") - c.y1.cast("int"))
    return _between(side / F.lit(reference), 0.0, 1.0)


def cells_covered(b: Box, width: Column, height: Column, cells_per_side: int = 20) -> Column:
    """Area of the unclipped box in grid cells when the image is a ``cells_per_side`` square grid."""
    bw = F.greatest(b.width, F.lit(0.0)) / width * cells_per_side
    bh = F.greatest(b.height, F.lit(0.0)) / height * cells_per_side
    return bw * bh


def coverage_prior(cells: Column, reference: float = 4.0) -> Column:
    return _between(cells / F.lit(reference), 0.0, 1.0)


def angle_of(cos: Column, sin: Column) -> Column:
    return F.atan2(sin, cos)


def orientation(x_from: Column, y_from: Column, x_to: Column, y_to: Column) -> Column:
    """Direction between two points; NULL when they coincide."""
    dx, dy = x_to - x_from, y_to - y_from
    return F.when(~((dx == 0) & (dy == 0)), F.atan2(dy, dx))


def wrap_angle(theta: Column) -> Column:
    return F.pmod(theta + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def moved_angle(theta: Column, sx=1.0, sy=1.0, hflip=False, vflip=False, rotation=0.0) -> Column:
    """Angle after scaling the direction by (sx, sy), flipping and rotating. Arguments may be columns."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    turned = F.atan2(col(sy) * F.sin(theta), col(sx) * F.cos(theta))
    turned = F.when(col(hflip), F.lit(math.pi) - turned).otherwise(turned)
    turned = F.when(col(vflip), -turned).otherwise(turned)
    return wrap_angle(turned + col(rotation))


def hflipped(b: Box, width: Column) -> Box:
    return Box(width - b.x2, b.y1, width - b.x1, b.y2)


def cropped(b: Box, left: Column, top: Column, width: Column, height: Column) -> Box:
    """Box seen from a crop window; empty results are removed with ``is_proper``."""
    return clipped(Box(b.x1 - left, b.y1 - top, b.x2 - left, b.y2 - top), width, height)


def resize_target(width: Column, height: Column, size: Column | int, max_size: int | None = None) -> tuple[Column, Column]:
    """New (width, height) when the shorter side becomes ``size``, limited so the longer side fits ``max_size``."""
    size = size if isinstance(size, Column) else F.lit(size)
    short, long = F.least(width, height), F.greatest(width, height)
    if max_size is not None:
        limited = F.bround(F.lit(float(max_size)) * short / long, 0).cast("int")
        size = F.when(long / short * size > max_size, limited).otherwise(size)
    new_w = F.when(width < height, size).otherwise((size * width / height).cast("int"))
    new_h = F.when(width < height, (size * height / width).cast("int")).otherwise(size)
    same = F.least(width, height) == size
    return F.when(same, width).otherwise(new_w), F.when(same, height).otherwise(new_h)


def pad_offsets(width: Column, height: Column, to_width: Column, to_height: Column, mode: str) -> tuple[Column, Column]:
    if mode == "right_bottom":
        return F.lit(0), F.lit(0)
    if mode == "center":
        return F.floor((to_width - width) / 2).cast("int"), F.floor((to_height - height) / 2).cast("int")
    if mode == "left_top":
        return to_width - width, to_height - height
    raise ValueError(f"unknown pad mode {mode}")


def shifted(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def center_crop_origin(width: Column, height: Column, crop_width: int, crop_height: int) -> tuple[Column, Column]:
    """(left, top) of a centred crop; halves round to even."""
    return (F.bround((width - crop_width) / 2.0, 0).cast("int"), F.bround((height - crop_height) / 2.0, 0).cast("int"))


class Letterbox(NamedTuple):
    """Scale and offsets that fit an image into a square with its aspect ratio kept."""

    scale: Column
    dx: Column
    dy: Column


def letterbox(width: Column, height: Column, side: int = 256) -> Letterbox:
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    half = lambda n: F.floor((F.lit(side) - (n * scale).cast("int")) / 2).cast("int")
    return Letterbox(scale, half(width), half(height))


def into_letterbox(x: Column, y: Column, lb: Letterbox) -> tuple[Column, Column]:
    return x * lb.scale + lb.dx, y * lb.scale + lb.dy


def out_of_letterbox(x: Column, y: Column, lb: Letterbox, width: Column, height: Column) -> tuple[Column, Column]:
    """Back to whole image pixels: truncate toward zero, then keep inside the image."""
    px = ((x - lb.dx) / lb.scale).cast("int")
    py = ((y - lb.dy) / lb.scale).cast("int")
    return _between(px, 0, width - 1), _between(py, 0, height - 1)


def block_boxes(df: DataFrame, width: str, height: str, n: int, whole_first: bool = False) -> DataFrame:
    """One row per cell of an n x n split of each image (row-major ``block_no``), optionally the whole image first."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    cell = lambda pos: F.struct(
        (pos + (1 if whole_first else 0)).cast("int").alias("block_no"),
        (w * (pos % n) / n).alias("x1"), (h * F.floor(pos / n) / n).alias("y1"),
        (w * (pos % n + 1) / n).alias("x2"), (h * (F.floor(pos / n) + 1) / n).alias("y2"),
    )
    cells = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)
    if whole_first:
        whole = F.struct(F.lit(0).alias("block_no"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), w.alias("x2"), h.alias("y2"))
        cells = F.concat(F.array(whole), cells)
    return df.select("*", F.inline(cells))


def sample_points(b: Box, width: Column, height: Column, n: int) -> Column:
    """Array of structs (sy, sx, x, y): the n x n sample points of a box clipped to its image, row by row; NULL where an argument is NULL."""
    left, top = F.greatest(b.x1, F.lit(0.0)), F.greatest(b.y1, F.lit(0.0))
    w, h = F.greatest(F.least(b.x2, width) - left, F.lit(1.0)), F.greatest(F.least(b.y2, height) - top, F.lit(1.0))
    at = lambda low, k, size: low + F.lit((k + 0.5) / n) * size
    points = F.array(*[F.struct(F.lit(sy).alias("sy"), F.lit(sx).alias("sx"), at(left, sx, w).alias("x"), at(top, sy, h).alias("y"))
                       for sy in range(n) for sx in range(n)])
    known = [c.isNotNull() for c in (*b, width, height)]
    return F.when(reduce(Column.__and__, known), points)
