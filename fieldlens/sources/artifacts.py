"""Writing crops, cutouts and masks as files, one per row, and cutting crops out of pixel arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.geometry import Box
from fieldlens.session import checkpoint_dir, ship_package
from fieldlens.sources.files import open_fs


def crop_pixels(pixels: Column, width: Column, window: Box) -> Column:
    """Row-major pixels of a window, cut row by row out of a flat array."""
    span = window.x2 - window.x1
    rows = F.sequence(window.y1, window.y2 - 1)
    cut = F.flatten(F.transform(rows, lambda y: F.slice(pixels, y * width + window.x1 + 1, span)))
    return F.when((span > 0) & (window.y2 > window.y1), cut).otherwise(F.slice(pixels, 1, 0))


def write_artifacts(artifacts: DataFrame, folder: str, encode: Callable[[bytes, str], bytes] | None = None) -> DataFrame:
    """Write ``content`` to ``folder/name`` for every (name, content) row; returns (name, bytes_written, error).

    ``folder`` is a path or URI of a store that pyarrow opens. Task attempts write under names of their own and report them; Spark keeps the
    report of one attempt of each task in a manifest, and only files named there are moved to their place, so killed and
    speculative attempts leave nothing. A move that was done before is done. A file is replaced as a whole. Rows of one name
    leave one file, of any of them. ``encode(content, extension)`` turns raw content into the file format; a row it or the store refuses
    gets its error and no file. Names outside the folder and null contents are refused. An empty table writes nothing.
    """
    spark = artifacts.sparkSession
    ship_package(spark)
    job = uuid.uuid4().hex
    staging = f"{folder.rstrip('/')}/_staging-{job}"
    manifest = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-{job}/manifest"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(staging)
        fs.create_dir(root)
        for batch in batches:
            out = []
            for name, content in zip(batch.name, batch.content):
                try:
                    if name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"{name} is outside the folder")
                    data = encode(content, name.rsplit(".", 1)[-1].lower()) if encode else content
                    temporary = f"{root}/{uuid.uuid4().hex}"
                    with fs.open_output_stream(temporary) as to:
                        to.write(data)
                    out.append((name, temporary, len(data), None))
                except Exception as e:  # one bad row must not stop the others
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "temporary", "bytes_written", "error"]).astype({"bytes_written": "Int64"})

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name, temporary in zip(batch.name, batch.temporary):
                fs.create_dir(os.path.dirname(f"{root}/{name}"))
                try:
                    fs.move(temporary, f"{root}/{name}")
                except FileNotFoundError:
                    if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                        raise
            yield batch[["name"]]

    schema = "name string, temporary string, bytes_written bigint, error string"
    try:
        artifacts.select("name", "content").mapInPandas(write, schema).write.parquet(manifest)
        kept = spark.read.schema(schema).parquet(manifest)
        # Rows of one name go through one task, so two moves to one place never meet.
        kept.where("temporary is not null").repartition("name").mapInPandas(move, "name string").write.format("noop").mode("overwrite").save()
    finally:
        fs, root = open_fs(staging)
        if fs.get_file_info(root).type != FileType.NotFound:
            fs.delete_dir(root)
    return kept.drop("temporary")
