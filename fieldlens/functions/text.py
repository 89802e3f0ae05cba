"""Path parts, digests, log-line fields and nested lookups as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.schemas import ARTIFACT_TYPES, IMAGE_EXTENSIONS

# ---- fixed values: the log-line formats ----
LOG_PATTERNS = {
    "compute": r"GPU Compute Time: min = (\d+\.\d+) ms, max = (\d+\.\d+) ms, mean = (\d+\.\d+) ms, median = (\d+\.\d+) ms",
    "h2d": r"Host to Device Transfer Time: min = (\d+\.\d+) ms, max = (\d+\.\d+) ms, mean = (\d+\.\d+) ms",
    "d2h": r"Device to Host Transfer Time: min = (\d+\.\d+) ms, max = (\d+\.\d+) ms, mean = (\d+\.\d+) ms",
    "latency": r"Latency: min = (\d+\.\d+) ms, max = (\d+\.\d+) ms, mean = (\d+\.\d+) ms",
}
THROUGHPUT_PATTERN = r"Throughput: (\d+\.\d+) qps"
LOG_FIELDS = ("min_ms", "max_ms", "mean_ms", "median_ms")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_supported(path: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def output_extension(path: Column) -> Column:
    """PNG inputs keep PNG (alpha survives); everything else is written as JPG."""
    return F.when(extension(path) == "png", "png").otherwise("jpg")


def suffixed_stem(stem_: Column, suffix: Column) -> Column:
    """``stem_suffix``, unless the stem already ends with that suffix."""
    tail = F.concat(F.lit("_"), suffix)
    return F.when(F.endswith(stem_, tail), stem_).otherwise(F.concat(stem_, tail))


def output_path(path: Column, suffix: Column, ext: Column, output_dir: Column | None = None) -> Column:
    folder = parent(path) if output_dir is None else output_dir
    return F.concat(folder, F.lit("/"), suffixed_stem(stem(path), suffix), F.lit("."), ext)


def numbered_output_path(path: Column, suffix: Column, index: Column, total: Column, ext: Column) -> Column:
    """As ``output_path``; several outputs get ``-index``, two digits wide from ten outputs on."""
    number = F.when(total >= 10, F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0"))) \
        .otherwise(index.cast("string"))
    mark = F.when(total == 1, F.lit("")).otherwise(F.concat(F.lit("-"), number))
    return F.concat(parent(path), F.lit("/"), suffixed_stem(stem(path), suffix), mark, F.lit("."), ext)


def metadata_path(path: Column, suffix: str = ".sidecar.toml", output_dir: Column | None = None) -> Column:
    folder = parent(path) if output_dir is None else output_dir
    return F.concat(folder, F.lit("/"), stem(path), F.lit(suffix))


def relative_to(path: Column, folder: Column) -> Column:
    """``path`` below ``folder`` with forward slashes; paths elsewhere stay as they are."""
    head = F.concat(folder, F.lit("/"))
    return F.when(F.startswith(path, head), F.replace(F.substr(path, F.length(head) + 1), F.lit("\\"), F.lit("/"))).otherwise(path)


def artifact_type(name: Column) -> Column:
    """First matching marker in the file name, ``Unknown`` when none matches."""
    chain = F.lit("Unknown")
    for marker, label in reversed(ARTIFACT_TYPES):
        chain = F.when(F.contains(name, F.lit(marker)), label).otherwise(chain)
    return chain


def versioned_name(name: Column, digest: Column) -> Column:
    """``stem-digest.ext`` (no dot when there is no extension)."""
    ext = F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
    return F.concat(stem(name), F.lit("-"), digest, ext)


def log_field(line: Column, kind: str, field: str) -> Column:
    """One number of a latency line, NULL when the line is of another kind."""
    return F.regexp_extract(line, LOG_PATTERNS[kind], LOG_FIELDS.index(field) + 1).try_cast("double")


def log_throughput(line: Column) -> Column:
    return F.regexp_extract(line, THROUGHPUT_PATTERN, 1).try_cast("double")


def log_duration(line: Column, marker: str) -> Column:
    """Milliseconds of a ``... in N ms`` line that contains ``marker``."""
    return F.when(F.contains(line, F.lit(marker)), F.regexp_extract(line, r" in (\d+(?:\.\d+)?)\s*ms", 1).try_cast("double"))


def nested_value(document: Column, path: str) -> Column:
    """Value at a dotted path of a JSON document, NULL when any step is missing."""
    return F.get_json_object(document, "$." + path)


def kept_entries(entries: Column, allowed: Sequence[str]) -> Column:
    """Listed keys with a non-empty value; NULL when none is left."""
    kept = F.map_filter(entries, lambda k, v: k.isin(*allowed) & v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)
