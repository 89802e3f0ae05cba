"""User models, error capture, table functions and observed metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from fieldlens.functions import models as U
from fieldlens.operators.decode import decode_detections


def test_model_to_detections(spark, tables):
    make = U.linear_detector(queries=6, classes=4, n_pixels=64)
    images = tables.grids.select("image_id", "cells").limit(50)
    raw = U.raw_outputs(images, U.detector_udf(make, [64], batch_size=16)("cells"), 6, 4)
    rows = raw.orderBy("image_id", "query_id").collect()
    assert len(rows) == 300 and len(rows[0].box) == 4 and len(rows[0].logits) == 4 and len(rows[0].orient) == 2
    cells = {r.image_id: r.cells for r in images.collect()}
    want = make()(np.array([cells[rows[0].image_id]]))
    np.testing.assert_allclose(rows[0].logits, want["logits"][0][:4])
    found = decode_detections(raw, tables.images, k=3, threshold=0.0)
    assert found.groupBy("image_id").count().agg(F.max("count")).first()[0] == 3


def test_error_capture(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "v string")
    out = U.apply_capturing_errors(df, "v", lambda s: int(s) * 2, T.IntegerType())
    rows = {r.v: (r.value, r.error) for r in out.collect()}
    assert rows["1"] == (2, None) and rows["3"] == (6, None) and rows["x"][0] is None and "ValueError" in rows["x"][1]
    assert tuple(U.failure_summary(out).first()) == (3, 2, 1)
    with pytest.raises(Exception, match="failed: ValueError"):
        U.require_success(out).collect()


def test_table_function(spark, tables):
    U.register_functions(spark)
    tables.grids.limit(2).createOrReplaceTempView("g2")
    rows = spark.sql("select image_id, c.* from g2, lateral grid_cells_of(cells, 8) c").collect()
    assert len(rows) == 128 and {(r.y, r.x) for r in rows} == {(y, x) for y in range(8) for x in range(8)}


def test_observed(spark):
    df, obs = U.observed(spark.range(10), "seen", n=F.count(F.lit(1)), top=F.max("id"))
    df.collect()
    assert obs.get == {"n": 10, "top": 9}
