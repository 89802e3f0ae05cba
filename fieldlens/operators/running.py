"""Running totals, row numbers and exact ranks that never put one whole group into one task.

Spark evaluates a window one partition key at a time, so a key holding a third of all rows would be one task.
The helpers here cut every group into slices that follow the window order, total the slices (map-side combined),
and add the totals of the earlier slices to a window that is computed inside each slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice_names(n: int) -> list[str]:
    return [f"_slice{i}" for i in range(n)]


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    slices: Sequence[Column],
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums per ``group`` in ``order``.

    ``slices`` are ascending expressions that agree with the order (a row of an earlier slice sorts earlier).
    """
    return _running(df, group, slices, order, sums, F.sum, lambda a, b: a + b)


def running_max(
    df: DataFrame, group: Sequence[str], slices: Sequence[Column], order: Sequence[Column], maxima: dict[str, Column]
) -> DataFrame:
    """Add inclusive running maxima per ``group`` in ``order`` (see ``running_sums`` for ``slices``)."""
    return _running(df, group, slices, order, maxima, F.max, F.greatest)


def _running(df, group, slices, order, values, agg, combine) -> DataFrame:
    group = list(group)
    names = _slice_names(len(slices))
    inputs = {out: f"_in_{out}" for out in values}
    sliced = df.select(
        "*", *[s.alias(n) for s, n in zip(slices, names)], *[v.alias(inputs[out]) for out, v in values.items()]
    )
    totals = sliced.groupBy(*group, *names).agg(*[agg(inputs[out]).alias(f"_tot_{out}") for out in values])
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, *names, *[agg(f"_tot_{out}").over(before).alias(f"_carry_{out}") for out in values])
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumns({f"_run_{out}": agg(inputs[out]).over(inside) for out in values})
    joined = local.join(carried, group + names, "left")
    results = [
        F.coalesce(combine(F.col(f"_run_{out}"), F.col(f"_carry_{out}")), F.col(f"_run_{out}")).alias(out) for out in values
    ]
    return joined.select(*[c for c in df.columns if c not in values], *results)


def rising_runs(
    df: DataFrame, group: Sequence[str], slices: Sequence[str], order: str, values: dict[str, Column], agg=F.sum, backward: bool = False
) -> DataFrame:
    """Add inclusive running results by the column ``order`` inside ``group``; they must never fall (maxima, sums of counts).

    ``slices`` are columns that agree with the order. The last result of a slice is its total, so ``df`` is shuffled once by group and slice
    and not made again for the totals; put the columns to carry into the struct ``order`` to keep that shuffle the same for later uses.
    ``backward`` runs from the last row to the first over the same shuffle.
    """
    keys = [*group, *slices]
    by = (lambda c: F.col(c).desc()) if backward else F.col
    inside = Window.partitionBy(*keys).orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({out: agg(v).over(inside) for out, v in values.items()})
    totals = local.groupBy(*keys).agg(*[F.max(out).alias(f"_tot_{out}") for out in values])
    before = Window.partitionBy(*group).orderBy(*[by(c) for c in slices]).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *[agg(f"_tot_{out}").over(before).alias(f"_carry_{out}") for out in values])
    joined = local.join(carried, keys, "left")
    both = lambda out: F.greatest(out, f"_carry_{out}") if agg is F.max else F.col(out) + F.coalesce(f"_carry_{out}", F.lit(0))
    return joined.select(*df.columns, *[both(out).alias(out) for out in values])


def row_numbers(
    df: DataFrame, group: Sequence[str], slices: Sequence[Column], order: Sequence[Column], out: str = "row_no"
) -> DataFrame:
    """1-based row numbers per ``group``; ``group`` may be empty for one corpus-wide numbering."""
    return running_sums(df, group, slices, order, {out: F.lit(1).cast("bigint")})


CROWD_BUCKETS = 1 << 16


def crowd_test(source: DataFrame, keys: Sequence[str], limit: int = 50_000) -> Column:
    """Whether a row's group may hold more than ``limit`` rows; never false for one that does, the same for all rows of a group.

    Groups are counted by hash bucket (map-side combined, at most 65,536 rows of a shuffle), so a small group that shares a bucket with a
    large one counts as crowded too. On very large tables the limit grows with the mean bucket. Use the result on tables whose group is
    named by the same ``keys`` with the same types.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(CROWD_BUCKETS)).cast("int")
    counts = source.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    full = counts.agg(F.collect_list(F.struct("_bucket", "_n")).alias("_l"), F.sum("_n").alias("_all"))
    most = F.greatest(F.lit(limit), F.floor(8 * F.col("_all") / CROWD_BUCKETS))
    crowded = full.select(F.transform(F.filter("_l", lambda e: e["_n"] > most), lambda e: e["_bucket"]).alias("_crowded"))
    return F.coalesce(F.array_contains(crowded.scalar(), bucket), F.lit(False))


def split_row_numbers(
    df: DataFrame, group: Sequence[str], slices: Sequence[Column], order: Sequence[Column], out: str = "row_no",
    source: DataFrame | None = None, limit: int = 50_000,
) -> DataFrame:
    """As ``row_numbers``; groups of at most ``limit`` rows are numbered by one window each, so that they are shuffled once."""
    crowded = crowd_test(df if source is None else source, group, limit)
    window = Window.partitionBy(*group).orderBy(*order)
    ordinary = df.filter(~crowded).select("*", F.row_number().over(window).cast("bigint").alias(out))
    return ordinary.unionByName(row_numbers(df.filter(crowded), group, slices, order, out))


def slice_count(df: DataFrame) -> int:
    """How many slices to cut: a few per shuffle partition, so that every task of a large cluster gets some."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, 2 * partitions)


def _quantiles(column: str, n: int, distinct: bool = True) -> Column:
    fractions = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])
    every = F.percentile_approx(F.col(column).cast("double"), fractions, 10 * n)
    return F.array_distinct(every) if distinct else every


def _with_place(df: DataFrame, out: str, bounds: Column, value: Column, n: int) -> DataFrame:
    """Add ``out``: how many of at most ``n`` ascending ``bounds`` are below ``value``. Halving steps, each a column on the one before, so that
    they are compiled and not evaluated as a function of arrays."""
    df = df.withColumn(out, F.lit(0))
    for k in reversed(range(n.bit_length())):
        at = F.col(out)
        df = df.withColumn(out, F.when(F.get(bounds, at + ((1 << k) - 1)) < value, at + (1 << k)).otherwise(at))
    return df


SLICE_COLUMNS = ("_at", "_on_bound", "_tie_at")


def value_slices(df: DataFrame, column: str, source: DataFrame | None = None, n: int | None = None) -> tuple[DataFrame, Column]:
    """``df`` with a helper column ``_at``, the slice of ``column`` between quantile bounds, and that column.

    The bounds are one row computed by a mergeable sketch, so slices hold about equal shares of all rows whatever
    the distribution of the values. Equal values always share a slice, so callers first collapse equal values.
    ``source`` may name a cheaper table with the same distribution.
    """
    n = n or slice_count(df)
    bounds = (df if source is None else source).agg(_quantiles(column, n).alias("_b"))
    with_bounds = df.withColumn("_bounds", bounds.scalar())
    placed = _with_place(with_bounds, "_at", F.col("_bounds"), F.col(column).cast("double"), n)
    return placed.select(*df.columns, "_at"), F.col("_at")


def split_slices(df: DataFrame, column: str, tie: str, source: DataFrame | None = None, n: int | None = None) -> tuple[DataFrame, list[Column]]:
    """Slices for the order (``column``, ``tie``) that also split a single value shared by very many rows.

    A value held by two n-ths of the rows or more is two of the quantiles at least; rows exactly on such a bound come
    last in their slice and are cut further by ``tie``. Returns the table with the helper columns ``SLICE_COLUMNS``
    (drop them later) and the slice expressions.
    """
    n = n or slice_count(df)
    both = F.struct(_quantiles(column, n, distinct=False).alias("v"), _quantiles(tie, n).alias("t"))
    bounds = (df if source is None else source).agg(both.alias("_q")).select(F.struct(
        F.array_distinct("_q.v").alias("v"), F.col("_q.t").alias("t"),
        F.transform(F.array_distinct("_q.v"), lambda v: F.size(F.filter("_q.v", lambda w: w == v)) > 1).alias("often")).alias("_b"))
    value, tied = F.col(column).cast("double"), F.col(tie).cast("double")
    placed = _with_place(df.withColumn("_both", bounds.scalar()), "_at", F.col("_both.v"), value, n)
    on_bound = F.coalesce(((F.get("_both.v", F.col("_at")) == value) & F.get("_both.often", F.col("_at"))).cast("int"), F.lit(0))
    marked = placed.withColumn("_on_bound", on_bound)
    marked = _with_place(marked, "_below", F.col("_both.t"), tied, n)
    tie_at = F.when(F.col("_on_bound") == 1, F.col("_below")).otherwise(F.lit(0))
    return marked.select(*df.columns, "_at", "_on_bound", tie_at.alias("_tie_at")), [F.col(c) for c in SLICE_COLUMNS]


def cumulative_counts(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Distinct values of ``column`` per group with their count ``n`` and running count ``cum``, ascending."""
    counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    sliced, slice_of = value_slices(counts, column)
    return running_sums(sliced, group, [slice_of], [F.col(column)], {"cum": F.col("n")}).drop("_at")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Corpus-wide average rank of every distinct value (ties share the mean of their positions)."""
    cum = cumulative_counts(df, [], column)
    return cum.select(column, (F.col("cum") - (F.col("n") - 1) / 2).cast("double").alias(out))


def order_statistics(df: DataFrame, group: Sequence[str], column: str, picks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group.

    ``picks`` maps an output name to a 1-based rank expression over ``size``, the number of rows of the group.
    """
    group = list(group)
    cum = cumulative_counts(df.filter(F.col(column).isNotNull()), group, column)
    sizes = df.filter(F.col(column).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    joined = cum.join(sizes, group) if group else cum.withColumn("size", sizes.scalar())
    low = F.col("cum") - F.col("n")
    return joined.groupBy(*group).agg(
        *[F.max(F.when((low < rank) & (rank <= F.col("cum")), F.col(column))).alias(out) for out, rank in picks.items()]
    )


def medians(df: DataFrame, group: Sequence[str], column: str, kind: str = "middle", out: str = "median") -> DataFrame:
    """Exact median per group: ``middle`` averages the two middle values, ``upper`` / ``lower`` pick one of them."""
    size = F.col("size")
    low = F.floor((size + 1) / 2)
    high = F.floor(size / 2) + 1
    if kind == "upper":
        return order_statistics(df, group, column, {out: high})
    if kind == "lower":
        return order_statistics(df, group, column, {out: low})
    both = order_statistics(df, group, column, {"_lo": low, "_hi": high})
    return both.select(*group, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))


def trailing_windows(
    df: DataFrame, group: Sequence[str], slices: Sequence[Column], order: Sequence[Column], width: int, block: int = 4096
) -> tuple[DataFrame, Window]:
    """Rows prepared for a trailing window of ``width`` rows, and that window.

    Rows are numbered, cut into blocks, and the last ``width - 1`` rows of a block are repeated at the head of the
    next block; the repeated rows carry ``_halo`` and must be filtered out after the window is evaluated.
    """
    if width > block:
        raise ValueError("block must be at least as long as the window")
    numbered = row_numbers(df, group, slices, order, "_pos")
    pos = F.col("_pos") - 1
    own = F.floor(pos / block)
    is_tail = (pos % block) >= block - (width - 1)
    blocks = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.select("*", F.posexplode(blocks).alias("_halo_no", "_block")).withColumn("_halo", F.col("_halo_no") > 0)
    window = Window.partitionBy(*group, "_block").orderBy("_pos").rowsBetween(-(width - 1), 0)
    return spread.drop("_halo_no"), window
