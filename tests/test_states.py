"""Mergeable aggregate states against the sorted form, in batches, merges and a stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import evaluation as E
from fieldlens.operators import states as S

SIZE = 2 * S.SCORE_BINS


def _matches(spark, rows):
    d = spark.createDataFrame(rows, "class_id int, image_id int, det_id int, confidence double, hit int, skip int")
    return d.select("class_id", "image_id", "det_id", F.col("det_id").alias("det_rank"), "confidence", F.lit("all").alias("area_range"),
                    F.array("hit").alias("tp"), F.array("skip").alias("ignored"))


def _state():
    return S.hit_state("confidence", F.get("tp", F.lit(0)), F.get("ignored", F.lit(0))).alias("state")


def _both(matches, counts):
    exact = {r[0]: r[1] for r in E.precision_table(matches, counts, (0.5,)).groupBy("class_id").agg(F.avg("precision")).collect()}
    states = matches.groupBy("class_id", F.expr("image_id % 3").alias("part")).agg(_state())
    states = states.groupBy("class_id").agg(S.merged_state("state", SIZE).alias("state"))
    got = counts.join(states, "class_id").select("class_id", S.state_precision("state", "n_truths").alias("ap")).collect()
    return exact, {r.class_id: r.ap for r in got}


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(0, "all", 40), (1, "all", 75)], "class_id int, area_range string, n_truths long")


def test_equal_where_no_bin_is_mixed(spark, counts):
    rng = np.random.default_rng(4)
    rows = []
    for cls in (0, 1):
        for b in range(S.SCORE_BINS):
            kind, skip = int(rng.random() < 0.4), int(rng.random() < 0.2)
            rows += [(cls, int(rng.integers(9)), b, (b + 0.5) / S.SCORE_BINS, kind, 0 if kind else skip)]
    exact, got = _both(_matches(spark, rows), counts)
    assert set(exact) == set(got) == {0, 1}
    for cls, ap in got.items():
        assert abs(ap.low - exact[cls]) < 1e-12 and abs(ap.high - exact[cls]) < 1e-12


def test_bounds_hold_the_exact_value(spark, counts):
    rng = np.random.default_rng(5)
    rows = [(c, int(rng.integers(9)), k, float(rng.random()), int(rng.random() < 0.3), 0) for c in (0, 1) for k in range(120)]
    exact, got = _both(_matches(spark, rows), counts)
    for cls, ap in got.items():
        assert ap.low - 1e-12 <= exact[cls] <= ap.high + 1e-12 and ap.low < ap.high


def test_both_forms_give_the_same_states(spark):
    rows = [(k % 2, k % 5, k, (k * 37 % 101) / 100 if k % 7 else None, int(k % 3 == 0), int(k % 4 == 0)) for k in range(90)] + [(9, 1, 1, None, 1, 0)]
    matches = _matches(spark, rows)
    keys = ["class_id", "image_id"]
    flag = lambda c: F.get(c, F.lit(0))
    plain = S.hit_states(matches, keys, F.col("confidence"), flag("tp"), flag("ignored"))
    key = lambda d: {tuple(r)[:-1]: r.state for r in d.collect()}
    assert key(plain) == key(matches.groupBy(*keys).agg(_state()))
    assert key(S.merged_states(plain, ["class_id"], SIZE)) == key(matches.groupBy("class_id").agg(_state()))


def test_nulls_extremes_and_no_truths(spark):
    rows = [(0, 1, 1, None, 1, 0), (0, 1, 2, 0.5, None, 0), (1, 1, 3, 1.0, 1, 0), (1, 1, 4, 0.0, 0, 0), (1, 1, 5, 7.0, 0, 0)]
    states = {r.class_id: r.state for r in _matches(spark, rows).groupBy("class_id").agg(_state()).collect()}
    assert states[0] == [0] * SIZE
    first, last = S.SCORE_BINS, SIZE - 1
    assert states[1][0] == 1 and states[1][first] == 1 and states[1][last] == 1 and sum(states[1]) == 3
    d = spark.createDataFrame([(states[1], 0), (states[0], 5), (states[1], None)], "state array<long>, n long")
    assert [r[0] if r[0] is None else tuple(r[0]) for r in d.select(S.state_precision("state", "n")).collect()] == [None, (0.0, 0.0), None]
    assert _matches(spark, []).groupBy("class_id").agg(_state()).count() == 0


def test_tile_means_merge(spark):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"g": rng.integers(0, 2, 300), "part": rng.integers(0, 5, 300), "tile": rng.integers(0, 3, 300), "v": rng.random(300)})
    parts = spark.createDataFrame(d).groupBy("g", "part").agg(S.mean_state("v", "tile", 4).alias("s"))
    got = {r.g: r.m for r in parts.groupBy("g").agg(S.state_means(S.merged_state("s", 8, "double"), 4).alias("m")).collect()}
    for g, want in d.groupby("g"):
        mean = want.groupby("tile").v.mean()
        np.testing.assert_allclose(got[g][:3], [mean[k] for k in range(3)], atol=1e-12)
        assert got[g][3] is None


def test_states_in_a_stream(spark, tmp_path):
    rows = [(k % 2, k % 5, k, (k * 37 % 101) / 100, int(k % 3 == 0), 0) for k in range(60)]
    batch = _matches(spark, rows)
    for part in range(3):
        batch.where(F.col("det_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (stream.groupBy("class_id").agg(_state()).writeStream.outputMode("complete").format("memory").queryName("hit_states")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    key = lambda d: {r.class_id: r.state for r in d.collect()}
    assert key(spark.table("hit_states")) == key(batch.groupBy("class_id").agg(_state()))
