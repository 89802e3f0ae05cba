"""Files behind URIs inside tasks, and JSON documents read by byte range."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BACK = 4096  # bytes looked back for the key in front of an array
_STEP = 1 << 20  # bytes read on for an element that crosses the end of its range
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or local path; Hadoop's names of object stores are understood."""
    scheme, rest = re.match(r"(?:([A-Za-z][\w+.-]*):)?(.*)", uri, re.S).groups()
    if scheme is None:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


class _Marks:
    """Braces and brackets outside strings in a run of bytes: places, and depths after them."""

    def __init__(self, data: bytes, in_string: bool, depth: int, before: bytes = b""):
        """``before``: the bytes in front, as far as a run of backslashes may reach."""
        buf = np.frombuffer(data, "u1")
        quotes = np.flatnonzero(buf == 34)
        if len(quotes):
            run = len(before) - len(before.rstrip(b"\\"))
            place = np.arange(len(buf))
            other = np.maximum.accumulate(np.where(buf != 92, place, -1))
            last = np.where(quotes > 0, other[quotes - 1], -1)
            slashes = quotes - 1 - last + np.where(last < 0, run, 0)
            quotes = quotes[slashes % 2 == 0]
        self.quotes = quotes
        marks = np.flatnonzero(np.isin(buf, np.frombuffer(b"{}[]", "u1")))
        inside = np.searchsorted(quotes, marks) % 2
        change = np.where((buf[marks] | 0x20) == 0x7B, 1, -1)  # { and [ differ in this bit alone
        self.deltas = tuple(int(change[inside == k].sum()) for k in (0, 1))  # outside and inside swapped if the run starts in a string
        self.at = marks[inside == int(in_string)]
        self.change = change[inside == int(in_string)]
        self.depth = depth + np.cumsum(self.change)
        self.byte = buf[self.at]


def _before(file, start: int) -> bytes:
    """The bytes in front of ``start``, far enough to hold a whole run of backslashes."""
    n = 64
    while True:
        got = file.read_at(min(n, start), start - min(n, start))
        if len(got) < n or got.rstrip(b"\\"):
            return got
        n *= 4


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> tuple[DataFrame, int]:
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    cut = files.where("length > 0").select("path", "length", starts.alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"), "length"), int(n)


def _per_range(run: Callable, schema: str) -> Callable:
    """Rows of ``run(file, row)`` for each range; ``file`` is a random access file."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["path"])
                with fs.open_input_file(path) as file:
                    rows = list(run(file, row))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return over


def json_ranges(spark: SparkSession, path: str, folder: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(path, start, stop, length, in_string, depth, section): byte ranges of JSON documents and the state at the start of each.

    Whether a range starts inside a string, and how deep, follows from what all ranges before it hold: every range counts its quotes and its
    braces for both cases alone, and sums over the ranges of a file, a row for each ``range_bytes``, settle it. ``section`` is the key of the
    top-level array that is open or was open last. The table is written to ``folder``, so each later reader opens a file once.
    """
    ranges, n = _ranges(spark, path, range_bytes)
    ranges = ranges.repartition(max(n, 1), "path", "start")

    def counted(file, row):
        m = _Marks(file.read_at(row["stop"] - row["start"], row["start"]), False, 0, _before(file, row["start"]))
        yield row["path"], row["start"], row["stop"], row["length"], len(m.quotes) % 2, *m.deltas

    counts = "path string, start bigint, stop bigint, length bigint, odd int, outside int, inside int"
    sums = ranges.mapInArrow(_per_range(counted, counts), counts)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("in_string", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    known = sums.withColumn("_d", change).withColumn("depth", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).cast("int"))
    known = known.select("path", "start", "stop", "length", "in_string", "depth").repartition(max(n, 1), "path", "start")

    def opened(file, row):
        last = [k for _, k in _sections(file, row, _read(file, row))]
        yield *(row[c] for c in ("path", "start", "stop", "length", "in_string", "depth")), last[-1] if last else None

    states = "path string, start bigint, stop bigint, length bigint, in_string int, depth int, last string"
    opened_ = known.mapInArrow(_per_range(opened, states), states)
    found = opened_.withColumn("section", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    found.write.parquet(folder)
    return spark.read.schema(found.schema).parquet(folder).repartition(max(n, 1), "path", "start")


def _read(file, row) -> _Marks:
    data = file.read_at(row["stop"] - row["start"], row["start"])
    marks = _Marks(data, bool(row["in_string"]), row["depth"], _before(file, row["start"]))
    marks.data = data
    return marks


def _sections(file, row, marks: _Marks) -> list[tuple[int, str]]:
    """Arrays opened in the range directly under the top object: place and key."""
    out = []
    for p in marks.at[(marks.depth == 2) & (marks.byte == 91)].tolist():
        end = row["start"] + p
        key = _KEY.search(file.read_at(min(_BACK, end), end - min(_BACK, end)))
        if key:
            out.append((p, key.group(1).decode()))
    return out


def json_elements(ranges: DataFrame, section: str) -> DataFrame:
    """(element): the objects of the top-level array ``section`` as JSON text, each read by the range in which it begins."""

    def elements(file, row):
        marks = _read(file, row)
        opened = _sections(file, row, marks)
        places, keys = [p for p, _ in opened], [row["section"], *(k for _, k in opened)]
        starts = marks.at[(marks.depth == 3) & (marks.byte == 123) & (marks.change == 1)]
        ends = marks.at[(marks.depth == 2) & (marks.byte == 125)] + 1
        for p in starts[[keys[k] == section for k in np.searchsorted(places, starts)]].tolist() if len(starts) else ():
            k = np.searchsorted(ends, p, "right")
            if k < len(ends):
                yield (marks.data[p:ends[k]].decode(),)
            else:
                yield (_rest(file, row["start"] + p, row["length"]),)

    return ranges.mapInArrow(_per_range(elements, "element string"), "element string")


def _rest(file, at: int, length: int) -> str:
    """The object that begins at ``at``, read step by step."""
    n = _STEP
    while True:
        data = file.read_at(min(n, length - at), at)
        marks = _Marks(data, False, 0)
        closed = marks.at[marks.depth == 0]
        if len(closed):
            return data[:closed[0] + 1].decode()
        if at + n >= length:
            raise ValueError(f"the document ends inside the element at byte {at}")
        n *= 4
