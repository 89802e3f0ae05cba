"""Image catalogs from files, directories and globs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.text import is_supported
from fieldlens.operators.selection import check_requested, last_source_wins, require_none
from fieldlens.schemas import BINARY_FILE


def source_kind(spark: SparkSession, source: str) -> str:
    """What the file system says a source is."""
    if any(c in source for c in "*?["):
        return "glob"
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    return "directory" if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory() else "file"


def list_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, length, modificationTime) of one source; contents are never read. Directories are not searched deeper."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    return reader.load(source).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", "modificationTime")


def read_image_catalog(spark: SparkSession, sources: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalog, rejects). A path listed by several sources belongs to the last of them.

    Rejects are unsupported files named explicitly or matched, and sources that match nothing. In strict mode any
    rejected named file, any source without a match, or an empty result is an error.
    """
    listed, rejects = None, []
    for i, source in enumerate(sources):
        try:
            files = list_files(spark, source)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rejects.append((source, "missing"))
            continue
        rows = files.select("path", F.lit(source).alias("source"), F.lit(source_kind(spark, source)).alias("source_type"), "length", "modificationTime", F.lit(i).alias("_order"))
        listed = rows if listed is None else listed.unionByName(rows)
    missing = spark.createDataFrame(rejects, "path string, reason string")
    if listed is None:
        if strict:
            raise ValueError(f"no usable images in {list(sources)}")
        empty = spark.createDataFrame([], "path string, source string, source_type string, length bigint, modificationTime timestamp")
        return empty, missing
    good = listed.filter(is_supported(F.col("path")))
    unsupported = listed.filter(~is_supported(F.col("path")))
    if strict:
        require_none(missing, "missing source")
        require_none(unsupported.filter("source_type <> 'directory'").select("path"), "unsupported file")
        if good.isEmpty():
            raise ValueError(f"no usable images in {list(sources)}")
    bad = missing.unionByName(unsupported.select("path", F.lit("unsupported").alias("reason")))
    return last_source_wins(good, "_order").drop("_order"), bad


def validate_catalog(requested: DataFrame, found: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    good, rejects = check_requested(requested, found)
    if strict:
        require_none(rejects, "rejected image")
    return good, rejects


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels by the built-in reader (path, height, width, nChannels, data); broken files give NULL data."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select(
        F.regexp_replace("image.origin", r"^file:/+", "/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def decode_images(files: DataFrame, decode: Callable[[bytes], tuple[int, int, int, bytes]]) -> DataFrame:
    """Decode (path, content) rows with a user function returning (height, width, channels, data).

    A file that cannot be decoded stays as a row with NULL pixels and the error text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    rows.append((path, *decode(bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "channels", "data", "error"]).astype(
                {"height": "Int32", "width": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, channels int, data binary, error string")


def stream_image_catalog(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New supported files of a folder as a stream of catalog rows."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length", "modificationTime").filter(is_supported(F.col("path")))
