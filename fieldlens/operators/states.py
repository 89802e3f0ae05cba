"""Aggregates as states: arrays of fixed size, made in ``groupBy().agg()``, merged by sums in any order, finished by a column expression.

A state may be kept in a table and merged with later ones, and works in streaming aggregations. ``hit_states`` and ``merged_states`` give the same
states over whole tables in two aggregates, by bin and then by key, where one aggregate would evaluate every bin for every row. Rows with a null score, flag, tile or
value count for nothing; a group of such rows alone gives the empty state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.schemas import RECALL_POINTS

SCORE_BINS = 100


def _sums(values: Callable[[int], Column], n: int, kind: str) -> list[Column]:
    return [F.coalesce(F.sum(values(i)), F.lit(0)).cast(kind) for i in range(n)]


def merged_state(state: Column | str, size: int, kind: str = "bigint") -> Column:
    """Aggregate: the state of all rows behind several states of ``size`` elements."""
    return F.array(*_sums(lambda i: F.get(state, F.lit(i)), size, kind))


def _place(score: Column, bins: int) -> Column:
    return (bins - 1 - F.greatest(F.least(F.floor(score * bins), F.lit(bins - 1)), F.lit(0))).cast("int")


def _listed(sums: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows (keys, __at, __n) as one array for each key; places without a row hold 0."""
    filled = F.map_from_entries(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", "__n"))))
    return sums.groupBy(*keys).agg(filled.alias("__m")).select(*keys, F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("bigint"))).alias("state"))


def hit_states(df: DataFrame, keys: Sequence[str], score: Column, tp: Column, ignored: Column, bins: int = SCORE_BINS) -> DataFrame:
    """(keys, state) of ``hit_state``. Columns named ``__at`` or ``__n`` can't be keys."""
    hit = F.when(tp == 1, F.lit(0)).when(ignored == 0, F.lit(bins))
    at = F.when(score.isNotNull() & tp.isNotNull() & ignored.isNotNull(), _place(score, bins) + hit)
    return _listed(df.select(*keys, at.alias("__at")).groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__n")), keys, 2 * bins)


def merged_states(states: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, state): the states of equal keys in the column ``state`` merged as by ``merged_state``."""
    each = states.select(*keys, F.posexplode("state").alias("__at", "__v"))
    each = each.where((F.col("__v") != 0) | (F.col("__at") == 0))  # one place stays, so that no key is lost
    return _listed(each.groupBy(*keys, "__at").agg(F.sum("__v").alias("__n")), keys, size)


def hit_state(score: Column | str, tp: Column | str, ignored: Column | str, bins: int = SCORE_BINS) -> Column:
    """Aggregate: true positives and then counted false positives by falling score in [0, 1], ``2 * bins`` numbers.

    ``tp`` and ``ignored`` are 0 or 1; scores outside [0, 1] fall into the first or the last bin.
    """
    score, tp, ignored = (F.col(c) if isinstance(c, str) else c for c in (score, tp, ignored))
    place = _place(score, bins)
    known = score.isNotNull() & ignored.isNotNull()
    return F.array(*_sums(lambda i: F.when(known & (place == i), tp), bins, "bigint"),
                   *_sums(lambda i: F.when(known & (place == i), (1 - tp) * (1 - ignored)), bins, "bigint"))


def state_precision(state: Column | str, n_truths: Column | str, bins: int = SCORE_BINS) -> Column:
    """Struct (low, high): bounds of the interpolated average precision of the rows behind a ``hit_state``; NULL without truths.

    The order inside a bin is not known. ``low`` puts its false positives first, ``high`` its true ones; the value of ``precision_table`` lies
    between them, and the three are equal where no bin holds both kinds.
    """
    state, n_truths = (F.col(c) if isinstance(c, str) else c for c in (state, n_truths))
    total = lambda first, n: F.aggregate(F.slice(state, first, n), F.lit(0).cast("bigint"), lambda s, v: s + v)
    step = lambda k: F.struct(total(F.lit(1), k + 1).alias("t"), total(F.lit(bins + 1), k).alias("f"), total(F.lit(bins + 1), k + 1).alias("g"))
    curve = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), step), lambda c: c["t"] > 0)

    def mean(steps: Column, false: str) -> Column:
        beyond = lambda j: F.filter(steps, lambda c: c["t"] / n_truths >= j * F.lit(0.01))
        best = lambda j: F.coalesce(F.array_max(F.transform(beyond(j), lambda c: c["t"] / (c["t"] + c[false]))), F.lit(0.0))
        points = F.transform(F.sequence(F.lit(0), F.lit(RECALL_POINTS - 1)), best)
        return F.aggregate(points, F.lit(0.0), lambda s, v: s + v) / RECALL_POINTS

    # Bound to one name so that the running sums are made once and not for each recall point.
    both = F.transform(F.array(curve), lambda steps: F.struct(mean(steps, "g").alias("low"), mean(steps, "f").alias("high")))
    return F.when(n_truths > 0, F.get(both, F.lit(0)))


def mean_state(value: Column | str, tile: Column | str, tiles: int) -> Column:
    """Aggregate: sums and then counts of ``value`` in tiles numbered from 0, ``2 * tiles`` doubles."""
    value, tile = (F.col(c) if isinstance(c, str) else c for c in (value, tile))
    return F.array(*_sums(lambda i: F.when(tile == i, value), tiles, "double"),
                   *_sums(lambda i: F.when((tile == i) & value.isNotNull(), F.lit(1)), tiles, "double"))


def state_means(state: Column | str, tiles: int) -> Column:
    """Array of tile means of a ``mean_state``; NULL for a tile without values."""
    return F.zip_with(F.slice(state, 1, tiles), F.slice(state, tiles + 1, tiles), F.try_divide)
