"""Sidecar metadata: one small document per image with a section per tool."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = ("detect", "cutout", "quality")
SECTIONS = ("execution", "system", "input")
_SCHEMA = "metadata_path string, tool string, core string, config string, execution string, system string, input string, error string"


def parse_sidecar(text: str) -> dict[str, dict]:
    """Tool sections of a document; anything that is not a named part is the free-form ``core``."""
    doc = tomllib.loads(text)
    out = {}
    for tool in TOOLS:
        if tool in doc:
            section = dict(doc[tool])
            parts = {k: section.pop(k) for k in ("config", *SECTIONS) if k in section}
            out[tool] = {"core": section.pop("core", section), **parts}
    return out


def read_sidecars(spark: SparkSession, folder: str, suffix: str = ".sidecar.toml") -> tuple[DataFrame, DataFrame]:
    """(one row per file and tool, quarantined files with the parse error). Parts are JSON text.

    A file that cannot be parsed counts as empty; its path and error go to the second table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    for tool, parts in parse_sidecar(bytes(content).decode()).items():
                        as_json = {k: json.dumps(v, default=str, sort_keys=True) for k, v in parts.items()}
                        rows.append([path, tool, *[as_json.get(k) for k in ("core", "config", *SECTIONS)], None])
                except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                    rows.append([path, None, None, None, None, None, None, str(e)])
            yield pd.DataFrame(rows, columns=names)

    parsed = files.mapInPandas(parse, _SCHEMA)
    good = parsed.filter("error is null").drop("error")
    return good, parsed.filter("error is not null").select("metadata_path", "error")


def sidecar_detections(sections: DataFrame) -> DataFrame:
    """Detections listed in the ``detect`` sections, one row each."""
    item = "array<struct<class_name:string,confidence:double,angle_radians:double,x1:double,y1:double,x2:double,y2:double,crop_path:string>>"
    rows = F.from_json(F.get_json_object("core", "$.detections"), item)
    return sections.filter("tool = 'detect'").select("metadata_path", F.posexplode(rows).alias("det_id", "d")).select("metadata_path", "det_id", "d.*")


def upsert_sections(existing: DataFrame, updates: DataFrame, key: str = "image_id", sections: Sequence[str] = TOOLS) -> DataFrame:
    """Sections of ``updates`` replace those of ``existing``; sections not supplied (NULL) are kept."""
    new = updates.select(key, *[F.col(s).alias(f"_new_{s}") for s in sections])
    return existing.join(new, key, "full_outer").select(key, *[F.coalesce(f"_new_{s}", s).alias(s) for s in sections])


def rounded_grid(grid: Column, digits: int = 2) -> Column:
    """Nested grid with cells rounded for writing."""
    return F.transform(grid, lambda row: F.transform(row, lambda v: F.round(v, digits)))


def to_rows(flat: Column, width: int) -> Column:
    """Flat row-major grid as an array of rows."""
    starts = F.sequence(F.lit(1), F.size(flat), F.lit(width))
    return F.transform(starts, lambda s: F.slice(flat, s, F.lit(width)))


def metadata_json(*columns: Column | str) -> Column:
    """JSON text of the given columns; NULL fields are left out."""
    return F.to_json(F.struct(*columns))


def write_metadata(sections: DataFrame, folder: str) -> None:
    """Canonical form: Parquet, one row per image and tool."""
    sections.write.mode("overwrite").parquet(folder)
