"""Table functions for SQL: sample points of a box, pixels of run lengths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F, types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_POINT = T.StructType([T.StructField("sy", T.IntegerType()), T.StructField("sx", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.udtf(returnType=_POINT)
class RoiPoints:
    """Lateral: the n x n sample points of a box clipped to its image, row by row; none where an argument is NULL.

    ``from boxes, lateral roi_points(x1, y1, x2, y2, width, height, 8)``
    """

    def eval(self, x1: float, y1: float, x2: float, y2: float, width: float, height: float, n: int) -> Iterator[tuple]:
        if None in (x1, y1, x2, y2, width, height, n):
            return
        left, top = max(x1, 0.0), max(y1, 0.0)
        w, h = max(min(x2, width) - left, 1.0), max(min(y2, height) - top, 1.0)
        for sy in range(n):
            for sx in range(n):
                yield sy, sx, left + (sx + 0.5) / n * w, top + (sy + 0.5) / n * h


@F.udtf
class RunPixels:
    """Polymorphic: rows (key, run number, length) of masks to rows (key, pos, m), the runs of a key in turn from ``start_value``.

    ``from run_pixels(table(runs), 1)``. The first three columns of the table are the key, of any type, the number and the length; the function
    asks Spark itself to partition by the key and order by the number, and holds one run at a time. NULL lengths count as 0.
    """

    @staticmethod
    def analyze(runs: AnalyzeArgument, start_value: AnalyzeArgument) -> AnalyzeResult:
        if not runs.isTable or len(runs.dataType.fields) < 3:
            raise ValueError("run_pixels needs a table of key, run number and length")
        key, number = runs.dataType.fields[0], runs.dataType.fields[1]
        schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("pos", T.IntegerType()), T.StructField("m", T.IntegerType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(number.name)])

    def __init__(self):
        self.pos = self.turn = 0

    def eval(self, row: T.Row, start_value: int) -> Iterator[tuple]:
        value = (start_value + self.turn) % 2
        self.turn += 1
        for _ in range(row[2] or 0):
            yield row[0], self.pos, value
            self.pos += 1


def register_table_functions(spark) -> None:
    """Make ``roi_points`` and ``run_pixels`` available to SQL."""
    spark.udtf.register("roi_points", RoiPoints)
    spark.udtf.register("run_pixels", RunPixels)
