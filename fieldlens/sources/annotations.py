"""Annotation tables: part annotations, COCO documents, opinion scores."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.schemas import CLASS_NAMES, COCO_DOCUMENT, MOS_LABELS
from fieldlens.session import checkpoint_dir, ship_package
from fieldlens.sources.files import json_elements, json_ranges, open_fs

# ---- fixed values: file names and columns of the space-separated part annotation tables ----
PART_TABLES = {
    "labels": ("image_class_labels.txt", "image_id bigint, class_id int"),
    "boxes": ("bounding_boxes.txt", "image_id bigint, x double, y double, w double, h double"),
    "splits": ("train_test_split.txt", "image_id bigint, is_train int"),
    "parts": ("parts/part_locs.txt", "image_id bigint, part_id int, x double, y double, visible int"),
}
NAMED_TABLES = {"images": ("images.txt", "bigint", "image_id", "path"), "classes": ("classes.txt", "int", "class_id", "name")}


def read_part_annotations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six tables by name. Paths and class names may hold spaces: only the first space separates."""
    tables = {
        name: spark.read.schema(schema).option("sep", " ").csv(f"{folder}/{file}") for name, (file, schema) in PART_TABLES.items()
    }
    for name, (file, kind, key, value) in NAMED_TABLES.items():
        both = F.split("value", " ", 2)
        tables[name] = spark.read.text(f"{folder}/{file}").filter(F.trim("value") != "").select(
            both[0].cast(kind).alias(key), F.trim(both[1]).alias(value))
    return tables


def read_coco(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> dict[str, DataFrame]:
    """images, annotations and categories out of COCO documents (one or many files, of any size).

    Documents are cut into byte ranges, each a row of its own, so one large document is read by many tasks. An element that is no
    JSON, or a document that ends inside one, fails the query.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-{uuid.uuid4().hex}/ranges"
    ranges = json_ranges(spark, path, folder, range_bytes)
    tables = {}
    for name, kind in ((f.name, f.dataType.elementType) for f in COCO_DOCUMENT.fields):
        parsed = F.from_json("element", kind, {"mode": "FAILFAST"})
        tables[name] = json_elements(ranges, name).select(parsed.alias("e")).select("e.*")
    return tables


def coco_annotations(annotations: DataFrame) -> DataFrame:
    """Flat annotation rows in COCO shape; an unknown orientation is NULL and left out of the written JSON."""
    return annotations.select(
        "id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd"), "orient")


def coco_categories(spark: SparkSession) -> DataFrame:
    """The fixed four categories."""
    return spark.createDataFrame([(i, n, "bird") for i, n in enumerate(CLASS_NAMES)], "id int, name string, supercategory string")


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, folder: str) -> None:
    """JSON-lines datasets partitioned by ``split``: the form that scales."""
    for name, table in (("images", images), ("annotations", annotations)):
        table.write.mode("overwrite").partitionBy("split").json(f"{folder}/{name}")
    categories.write.mode("overwrite").json(f"{folder}/categories")


def write_coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, folder: str) -> list[str]:
    """One document ``folder/<split>.json`` for each split of ``images`` and ``annotations``, which ``read_coco`` reads back; returns the splits.

    Elements become JSON text in a distributed write below ``folder``; then one task for each split strings its parts together in constant memory.
    Whichever attempts ran, a document appears whole, by one rename of the finished file on the driver, one for each split; a split
    written before is replaced, and a failed write leaves the earlier documents as they were. A null split is named ``null``.
    """
    spark = images.sparkSession
    ship_package(spark)
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    split = lambda df: F.coalesce(F.col("split").cast("string"), F.lit("null")).alias("split")
    rows = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != "split"])).alias("value")
    for name, table in (("images", images), ("annotations", annotations)):
        table.select(split(table), rows(table)).write.partitionBy("split").text(f"{staging}/{name}")
    categories.select(rows(categories)).write.text(f"{staging}/categories")
    names = images.select(split(images)).union(annotations.select(split(annotations))).distinct()

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch.split:
                fs, root = open_fs(staging)
                temporary = f"{root}/{uuid.uuid4().hex}.json"
                with fs.open_output_stream(temporary) as to:
                    for k, section in enumerate(("images", "annotations", "categories")):
                        to.write(f'{", " if k else "{"}"{section}": ['.encode())
                        part = f"{root}/{section}" + ("" if section == "categories" else f"/split={_escaped(name)}")
                        _join_lines(fs, part, to)
                        to.write(b"]")
                    to.write(b"}\n")
                out.append((name, temporary))
            yield pd.DataFrame(out, columns=["split", "temporary"])

    made = names.repartition(max(1, min(names.count(), 10_000)), "split").mapInPandas(assemble, "split string, temporary string").collect()
    fs, root = open_fs(folder)
    for r in made:
        fs.move(r.temporary, f"{root}/{_escaped(r.split)}.json")
    fs.delete_dir(open_fs(staging)[1])
    return sorted(r.split for r in made)


def _escaped(value: str) -> str:
    """A partition value as it stands in Spark's folder names."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or ord(c) < 32 else c for c in value)


def _join_lines(fs, folder: str, to) -> None:
    """Write the lines of the text files in ``folder`` with commas between them; no folder, no lines."""
    first = True
    for info in sorted(fs.get_file_info(FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
        if not info.is_file or info.base_name.startswith(("_", ".")):
            continue
        with fs.open_input_stream(info.path) as lines:
            for line in io.TextIOWrapper(lines, "utf-8", newline="\n"):
                if text := line.rstrip("\n"):
                    to.write((text if first else ",\n" + text).encode())
                    first = False


def read_mos_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MOS_LABELS).option("header", "true").csv(path)


def mos_regions(labels: DataFrame) -> DataFrame:
    """Wide label rows to one row per scored region: the image and its three patches."""
    def region(name: str) -> Column:
        return F.struct(F.lit(name).alias("region"), F.col(f"mos_{name}").alias("mos"),
                        *[F.col(f"{s}_{name}").alias(s) for s in ("left", "top", "right", "bottom")])

    names = ("image", "patch_1", "patch_2", "patch_3")
    return labels.select("name_image", "is_valid", F.inline(F.array(*[region(n) for n in names])))
