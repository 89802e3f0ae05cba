"""Annotated datasets: part groups, annotation assembly, splits, training targets and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions.geometry import Box
from fieldlens.operators.running import row_numbers, value_slices
from fieldlens.operators.selection import seeded_unit, shuffled_halves
from fieldlens.schemas import CLASS_NAMES, PART_GROUPS


def visible_parts(parts: DataFrame) -> DataFrame:
    """Visible parts with the group they belong to; a part may be in several groups."""
    groups = F.array(*[
        F.when(F.col("part_id").isin(*ids), F.lit(name)) for name, ids in PART_GROUPS.items()
    ])
    return parts.filter(F.col("visible") != 0).select("*", F.explode(F.array_compact(groups)).alias("part_group"))


def group_extents(parts: DataFrame, margin: float = 10.0) -> DataFrame:
    """Per image and part group: padded box (x, y, w, h) and centre of the visible points.

    The corner moves out by the margin (not below 0) and the size adds two more margins to the distance from it.
    """
    c = visible_parts(parts).groupBy("image_id", "part_group").agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    x, y = F.greatest(F.lit(0.0), F.col("_x0") - margin), F.greatest(F.lit(0.0), F.col("_y0") - margin)
    return c.select("image_id", "part_group", x.alias("x"), y.alias("y"), (F.col("_x1") - x + 2 * margin).alias("w"),
                    (F.col("_y1") - y + 2 * margin).alias("h"), "cx", "cy")


def group_orientations(extents: DataFrame) -> DataFrame:
    """Per image: whole-bird direction (crown to tail) and head direction (eyes to beak), NULL when a group is unseen."""
    at = lambda g, f: F.max(F.when(F.col("part_group") == g, F.col(f)))
    names = [(g, f) for g in ("crown", "tail", "eye", "beak") for f in ("cx", "cy")]
    wide = extents.groupBy("image_id").agg(*[at(g, f).alias(f"{g}_{f}") for g, f in names])
    line = lambda a, b: G.orientation(F.col(f"{a}_cx"), F.col(f"{a}_cy"), F.col(f"{b}_cx"), F.col(f"{b}_cy"))
    return wide.select("image_id", line("crown", "tail").alias("bird_orient"), line("eye", "beak").alias("head_orient"))


def assemble_annotations(images: DataFrame, boxes: DataFrame, parts: DataFrame, margin: float = 10.0) -> DataFrame:
    """Images with their optional object box and optional part boxes as annotation rows (category, box, area, orient).

    All part aggregates share one grouping by image, so the assembly is two joins on image_id and no numbering yet.
    """
    extents = group_extents(parts, margin)
    box = F.struct("x", "y", "w", "h")
    per_image = extents.groupBy("image_id").agg(*[
        F.max(F.when(F.col("part_group") == g, box)).alias(f"{g}_box") for g in ("head", "eye", "beak")
    ]).join(group_orientations(extents), "image_id", "left")
    whole = boxes.select("image_id", F.struct("x", "y", "w", "h").alias("bird_box"))
    joined = images.join(whole, "image_id", "left").join(per_image, "image_id", "left")
    orient = {"bird": F.col("bird_orient"), "head": F.col("head_orient")}

    def annotation(category_id: int, name: str) -> Column:
        b = F.col(f"{name}_box")
        a = G.annotation_box(b["x"], b["y"], b["w"], b["h"], F.col("width"), F.col("height"))
        theta = orient.get(name, F.lit(None).cast("double"))
        return F.when(b.isNotNull(), F.struct(
            F.lit(category_id).alias("category_id"), *[a[k].alias(k) for k in ("x", "y", "w", "h", "area")], F.lit(0).alias("iscrowd"), theta.alias("orient")))

    rows = F.array_compact(F.array(*[annotation(i, n) for i, n in enumerate(CLASS_NAMES)]))
    return joined.select("image_id", F.inline(rows))


def number_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Add ids from 1 in image order, by category inside an image, without sorting everything in one task."""
    ready, slice_of = value_slices(annotations, "image_id", source=images)
    numbered = row_numbers(ready, [], [slice_of], [F.col("image_id"), F.col("category_id")], "id")
    return numbered.drop("_at")


def parts_to_annotations(images: DataFrame, boxes: DataFrame, parts: DataFrame) -> DataFrame:
    return number_annotations(assemble_annotations(images, boxes, parts), images)


def dataset_summary(images: DataFrame, annotations: DataFrame, split: str = "split") -> DataFrame:
    """Images, annotations and used categories per split, from one aggregate per table."""
    per_split = annotations.join(images.select("image_id", split), "image_id").groupBy(split).agg(
        F.count(F.lit(1)).alias("n_annotations"), F.size(F.collect_set("category_id")).cast("bigint").alias("n_categories"))
    return images.groupBy(split).agg(F.count(F.lit(1)).alias("n_images")).join(per_split, split, "left").fillna(0, ["n_annotations", "n_categories"])


def split_holdout(images: DataFrame, annotations: DataFrame, seed: int = 42, prefix: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Images with a ``valid`` / ``test`` half and a rewritten path, and annotations following their image."""
    halves = shuffled_halves(images, "image_id", seed)
    if prefix:
        old, new = prefix
        moved = F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))
        halves = halves.withColumn("path", F.when(F.startswith("path", F.lit(old)), moved).otherwise(F.col("path")))
    return halves, annotations.join(halves.select("image_id", "split"), "image_id")


def training_targets(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Corner boxes inside the image without crowds and empty boxes; ``orient`` stays NULL where unknown."""
    kept = annotations.filter(F.coalesce("iscrowd", F.lit(0)) == 0)
    sized = kept.join(images.select("image_id", "width", "height"), "image_id")
    b = G.clipped(G.corners_from_size(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.col("width"), F.col("height"))
    rest = [c for c in kept.columns if c not in ("x", "y", "w", "h")]
    return sized.select(*rest, "width", "height", *b.named()).filter(G.is_proper(Box.of()))


def augment_targets(
    targets: DataFrame, epochs: int, seed: int = 0, size: int = 560, max_size: int = 1333, first_sizes=(400, 500, 600), crop_range=(384, 600)
) -> DataFrame:
    """Augmented boxes and angles, one set per (image, epoch): flip half of the time, then either resize, or resize,
    crop at random and resize again. Every choice is a hash of image, epoch and seed, so retries repeat it.

    Input: image_id, det_id, width, height, x1..y2, area, orient (nullable).
    """
    key = F.concat_ws(":", F.col("image_id").cast("string"), F.col("epoch").cast("string"))
    unit = lambda salt: seeded_unit(key, seed, salt)
    pick = lambda lo, hi, salt: F.least((lo + F.floor(unit(salt) * (hi - lo + 1))).cast("int"), hi)
    c = F.col
    d = targets.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    d = _settled(d, {"flipped": unit("flip") < 0.5, "cropped": unit("branch") >= 0.5})
    b = G.hflipped(Box.of(), c("width").cast("double"))
    flipped = {n: F.when(c("flipped"), v).otherwise(c(n)) for n, v in zip(Box._fields, b)}
    d = _settled(d, {**flipped, "orient": F.when(c("flipped"), G.moved_angle(c("orient"), hflip=True)).otherwise(c("orient"))})
    first = F.get(F.array(*[F.lit(s) for s in first_sizes]), F.floor(unit("first") * len(first_sizes)).cast("int"))
    d = _resized(d, first, None, c("cropped"))
    lo, hi = crop_range
    d = _settled(d, {"_cw": pick(F.least(F.lit(lo), c("width")), F.least(c("width"), F.lit(hi)), "cw"),
                     "_ch": pick(F.least(F.lit(lo), c("height")), F.least(c("height"), F.lit(hi)), "ch")})
    d = _settled(d, {"_left": pick(F.lit(0), c("width") - c("_cw"), "left"), "_top": pick(F.lit(0), c("height") - c("_ch"), "top")})
    cut = G.cropped(Box.of(), c("_left"), c("_top"), c("_cw"), c("_ch"))
    d = _settled(d, {n: F.when(c("cropped"), v).otherwise(c(n)) for n, v in zip(Box._fields, cut)})
    d = d.filter(G.is_proper(Box.of())).withColumns({
        "area": F.when(c("cropped"), G.area(Box.of())).otherwise(c("area")),
        "width": F.when(c("cropped"), c("_cw")).otherwise(c("width")), "height": F.when(c("cropped"), c("_ch")).otherwise(c("height")),
    })
    d = _resized(d, F.lit(size), max_size, F.lit(True))
    return d.select(*targets.columns, "epoch", "flipped", "cropped")


def _settled(d: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set columns behind a generator step: later expressions refer to the values instead of repeating their text."""
    keep = [c for c in d.columns if c not in columns]
    return d.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))


def _resized(d: DataFrame, size: Column, max_size: int | None, only: Column) -> DataFrame:
    """Resize image and boxes so the shorter side is ``size`` where ``only`` holds."""
    c = F.col
    w, h = G.resize_target(c("width"), c("height"), size, max_size)
    d = _settled(d, {"_nw": F.when(only, w).otherwise(c("width")), "_nh": F.when(only, h).otherwise(c("height"))})
    sx, sy = c("_nw") / c("width"), c("_nh") / c("height")
    moved = dict(zip(Box._fields, G.scaled(Box.of(), sx, sy)))
    d = _settled(d, {**moved, "area": c("area") * (sx * sy), "orient": G.moved_angle(c("orient"), sx, sy)})
    return d.withColumns({"width": c("_nw"), "height": c("_nh")}).drop("_nw", "_nh")
