"""Sliced running totals, ranks and medians against plain pandas, with one key or value holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import running as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n)), "i": np.arange(n),
        "v": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 500, n) / 4.0)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_row_numbers_and_sums(skewed):
    pdf, df = skewed
    out = R.row_numbers(df, ["k"], [F.floor(F.col("i") / 100)], [F.col("i")], "no").toPandas().sort_values("i")
    assert (out.no.to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()
    out = R.running_sums(df, ["k"], [F.floor(F.col("i") / 100)], [F.col("i")], {"s": F.col("v")}).toPandas().sort_values("i")
    np.testing.assert_allclose(out.s, pdf.groupby("k").v.cumsum())
    out = R.running_max(df, ["k"], [F.floor(F.col("i") / 100)], [F.col("i")], {"m": F.col("v")}).toPandas().sort_values("i")
    np.testing.assert_allclose(out.m, pdf.groupby("k").v.cummax())


def test_split_slices_agree_with_order(skewed):
    pdf, df = skewed
    ready, slices = R.split_slices(df, "v", "i")
    assert len(ready.select(*slices).filter("v = 7").distinct().collect()) > 10  # the shared value is split
    out = R.row_numbers(ready, [], slices, [F.col("v"), F.col("i")], "no").toPandas().sort_values(["v", "i"])
    assert (out.no.to_numpy() == np.arange(1, len(pdf) + 1)).all()


@pytest.mark.parametrize("kind", ["middle", "upper", "lower"])
def test_medians(skewed, kind):
    pdf, df = skewed
    got = {r.k: r.median for r in R.medians(df, ["k"], "v", kind).collect()}
    for k, g in pdf.groupby("k"):
        s = np.sort(g.v)
        n = len(s)
        want = {"middle": np.median(s), "upper": s[n // 2], "lower": s[(n - 1) // 2]}[kind]
        assert got[k] == want


def test_average_ranks(skewed):
    pdf, df = skewed
    got = {r.v: r.rk for r in R.average_ranks(df, "v", "rk").collect()}
    want = pdf.v.rank(method="average")
    assert all(got[v] == w for v, w in zip(pdf.v, want))


def test_trailing_windows_cross_blocks(skewed):
    pdf, df = skewed
    spread, w = R.trailing_windows(df, ["k"], [F.floor(F.col("i") / 100)], [F.col("i")], width=20, block=64)
    out = spread.withColumn("a", F.avg("v").over(w)).filter("not _halo").toPandas().sort_values("i")
    assert len(out) == len(pdf)
    want = pdf.groupby("k").v.rolling(20, min_periods=1).mean().reset_index(0, drop=True).sort_index()
    np.testing.assert_allclose(out.a, want)


def test_small_groups_are_numbered_in_one_shuffle_and_crowded_ones_by_slices(spark):
    rows = [(0, i % 40, (i * 7919) % 9973) for i in range(3000)] + [(1 + i % 500, i % 7, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, a int, b int").repartition(8)
    order = [F.col("a"), F.col("b")]
    got = {tuple(r)[:3]: r.n for r in R.split_row_numbers(df, ["k"], order[:1], order, "n", limit=500).collect()}
    seen = {}
    for row in sorted(rows):
        seen[row[0]] = seen.get(row[0], 0) + 1
        assert got[row] == seen[row[0]]
    crowd = {r.k for r in df.filter(R.crowd_test(df, ["k"], 500)).select("k").distinct().collect()}
    assert 0 in crowd and len(crowd) < 5


def test_rising_runs_forward_and_backward(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 100).alias("s"), F.struct("id").alias("row"), (F.col("id") % 13).alias("v"))
    up = R.rising_runs(df, ["k"], ["s"], "row", {"n": F.lit(1), "top": F.lit(0)}).select("k", "s", "row", "v", "n")
    down = R.rising_runs(up, ["k"], ["s"], "row", {"m": F.col("v") + F.col("row.id")}, F.max, backward=True)
    assert all(r.n == r.row.id // 2 + 1 for r in up.collect())
    rows = down.collect()
    for r in rows[::97]:
        assert r.m == max(x.v + x.row.id for x in rows if x.k == r.k and x.row.id >= r.row.id)


def test_only_frequent_values_are_split_by_tie(spark):
    """A value that is one quantile alone is no reason for a slice of its own for each tie bound."""
    df = spark.range(20_000).select((F.col("id") % 1000).cast("double").alias("v"), "id")
    ready, slices = R.split_slices(df, "v", "id", n=64)
    assert ready.select(*slices).distinct().count() <= 64
