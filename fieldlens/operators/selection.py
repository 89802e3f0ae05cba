"""Top-k, thresholds, class names, catalog rules, splits and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators.running import row_numbers
from fieldlens.schemas import CLASS_NAMES, SHIFTED_MODEL_SIZE


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Catalyst keeps at most ``k`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def class_name(class_id: Column, model_size: int | None = None) -> Column:
    """Name of a class id, ``unknown`` for ids without a bird-part class (background included)."""
    shift = 1 if model_size == SHIFTED_MODEL_SIZE else 0
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.coalesce(F.get(names, (class_id - shift).cast("int")), F.lit("unknown"))


def known_classes(df: DataFrame, model_size: int | None = None) -> DataFrame:
    """Add ``class_name`` and drop rows whose class has no name."""
    return df.withColumn("class_name", class_name(F.col("class_id"), model_size)).filter(F.col("class_name") != "unknown")


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]], keys: Sequence[str]) -> DataFrame:
    """One row per (row, column) whose value lies outside its range."""
    checks = [
        F.when(~F.col(c).between(lo, hi), F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")))
        for c, (lo, hi) in ranges.items()
    ]
    return df.select(*keys, F.inline(F.array_compact(F.array(*checks))))


def non_finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is NaN or infinite."""
    c = F.col(column)
    return df.filter(F.isnan(c) | (F.abs(c) == float("inf")))


def finite(df: DataFrame, column: str) -> DataFrame:
    """The other rows; a NULL value is not a wrong number and stays."""
    c = F.col(column)
    return df.filter(c.isNull() | ~(F.isnan(c) | (F.abs(c) == float("inf"))))


# ---- catalog -------------------------------------------------------------------------------------------------------

def last_source_wins(catalog: DataFrame, source_order: str) -> DataFrame:
    """One row per path, from the source given last."""
    rest = [c for c in catalog.columns if c != "path"]
    newest = catalog.groupBy("path").agg(F.max(F.struct(source_order, *[c for c in rest if c != source_order])).alias("_r"))
    return newest.select("path", *[F.col(f"_r.{c}").alias(c) for c in rest])


def check_requested(requested: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects) of requested paths: unsupported type, or not found."""
    marks = found.select("path").distinct().withColumn("_found", F.lit(True))
    joined = requested.join(marks, "path", "left").withColumn(
        "reason",
        F.when(~text.is_supported(F.col("path")), "unsupported").when(F.col("_found").isNull(), "missing"),
    ).drop("_found")
    return joined.filter(F.col("reason").isNull()).drop("reason"), joined.filter(F.col("reason").isNotNull())


def require_none(rejects: DataFrame, what: str) -> None:
    """Strict mode: fail when there is any reject, naming one."""
    bad = rejects.limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def stem_collisions(catalog: DataFrame) -> DataFrame:
    """Stems shared by several distinct input paths: outputs in one folder would overwrite each other."""
    paths = catalog.select("path").distinct().withColumn("stem", text.stem(F.col("path")))
    return paths.groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    ).filter("n_paths > 1")


def colliding_paths(catalog: DataFrame) -> DataFrame:
    """Every path of a colliding stem, one row each (the message a caller prints, in long form)."""
    paths = catalog.select("path").distinct().withColumn("stem", text.stem(F.col("path")))
    return paths.join(stem_collisions(catalog).select("stem"), "stem", "left_semi")


def inventory(files: DataFrame) -> DataFrame:
    """Count and megabytes of regular files; lock files and hidden files do not count."""
    name = text.file_name(F.col("path"))
    kept = files.filter(~F.startswith(name, F.lit(".")) & (text.extension(F.col("path")) != "lock"))
    return kept.agg(F.count(F.lit(1)).alias("n_files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("total_mb"))


def numbered_crops(detections: DataFrame, classes: Sequence[str], per_class: bool = False) -> DataFrame:
    """Add ``crop_path``; rows of other classes stay with NULL.

    ``detections`` come out of the per-image top-k, which bounds the rows per image, so a window per image is small.
    The number counts all detections of the image while the total is per class; ``per_class`` numbers within the class.
    """
    if "all" in classes:
        classes = CLASS_NAMES
    image = Window.partitionBy("image_id").orderBy(F.col("confidence").desc(), "det_id")
    same_class = Window.partitionBy("image_id", "class_name")
    index = F.row_number().over(same_class.orderBy(F.col("confidence").desc(), "det_id") if per_class else image)
    total = F.count(F.lit(1)).over(same_class)
    numbered = detections.withColumns({"_index": index, "_total": total})
    path = text.numbered_output_path(
        F.col("path"), F.concat(F.lit("crop_"), F.col("class_name")), F.col("_index"), F.col("_total"),
        text.output_extension(F.col("path")),
    )
    return numbered.withColumn("crop_path", F.when(F.col("class_name").isin(*classes), path)).drop("_index", "_total")


# ---- splits and sampling -------------------------------------------------------------------------------------------

def shuffled_halves(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Deterministic shuffle: the first half (rounded down) is ``valid``, the rest ``test``.

    The order is the digest of key and seed; its leading digits cut the rows into equal slices.
    """
    digest = df.withColumn("_digest", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    numbered = row_numbers(digest, [], [F.substring("_digest", 1, 3)], [F.col("_digest"), F.col(key)], "_no")
    half = F.floor(df.agg(F.count(F.lit(1)).alias("n")).scalar() / 2)
    return numbered.withColumn("split", F.when(F.col("_no") <= half, "valid").otherwise("test")).drop("_digest", "_no")


def seeded_unit(key: Column, seed: int, salt: str = "") -> Column:
    """A repeatable number in [0, 1) per key: the first 52 bits of a digest, which other engines compute too."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample_rows(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    return df.filter(seeded_unit(F.col(key), seed) < p)


def split_check(parts: Sequence[DataFrame], source: DataFrame, key: str) -> DataFrame:
    """One row: keys in more than one part, keys of the source in no part, keys outside the source."""
    tagged = None
    for i, p in enumerate(parts):
        d = p.select(key).distinct().withColumn("_part", F.lit(i))
        tagged = d if tagged is None else tagged.unionByName(d)
    per_key = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = source.select(key).distinct().withColumn("_src", F.lit(1)).join(per_key, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_n") > 1).alias("in_several"), F.count_if(F.col("_n").isNull()).alias("in_none"),
        F.count_if(F.col("_src").isNull()).alias("outside"),
    )


def most_recent(items: DataFrame, key: str, ts: str, tie: str, n: int = 10) -> DataFrame:
    """Newest ``n`` items after keeping the newest row of every key."""
    rest = [c for c in items.columns if c not in (key, ts, tie)]
    newest = items.groupBy(key).agg(F.max(F.struct(ts, tie, *rest)).alias("_r"))
    flat = newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in (ts, tie, *rest)])
    return flat.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
