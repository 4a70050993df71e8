"""Statistics that need more than one built-in aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import lookup

# Scale of the median absolute deviation for a normal law, and
# the two normal quantiles used for intervals.
MAD_SCALE = 1.4826
Z975 = 1.959963984540054


def sum0(col: Column) -> Column:
    """Sum that is 0, not NULL, when nothing is there."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def strict_sum(col: Column) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def residual_sigma(y: Column, x: Column) -> Column:
    """Residual standard error of the regression of y on x."""
    n = F.regr_count(y, x)
    rss = F.regr_syy(y, x) - F.try_divide(
        F.pow(F.regr_sxy(y, x), F.lit(2)), F.regr_sxx(y, x)
    )
    return F.sqrt(F.greatest(F.try_divide(rss, n - 2), F.lit(0.0)))


# Rational approximation of the normal distribution function
# (Abramowitz and Stegun 26.2.17, error below 7.5e-8).
_CDF_P = 0.2316419
_CDF_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_cdf(z: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_CDF_P) * F.abs(z))
    poly = reduce(lambda acc, b: (acc + F.lit(b)) * t, reversed(_CDF_B), F.lit(0.0))
    tail = F.exp(-z * z / 2.0) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def box_cox_half(x: Column) -> Column:
    """Box-Cox transform with exponent one half."""
    return F.lit(2.0) * (F.sqrt(x) - 1)


def inv_box_cox_half(y: Column) -> Column:
    return F.pow(F.lit(1.0) + y / 2.0, F.lit(2.0))


def scaled(value: Column, keys: list[str]) -> Column:
    """z-score within the group, plus one."""
    w = W.partitionBy(*keys)
    return F.try_divide(value - F.avg(value).over(w), F.stddev_samp(value).over(w)) + 1


def _null_safe(keys: list[str], extra: list | None = None) -> Column:
    conds = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + (extra or [])
    return reduce(lambda a, b: a & b, conds)


def running_totals(
    df: DataFrame, keys: list[str], value: str, weight: Column, order: list[str], pieces: int | None = None
) -> DataFrame:
    """Add ``_end``, the running sum of ``weight`` in the order of ``value``
    (then ``order``) within each group, and ``_total``.

    A plain window would sort a whole group in one task. Groups are cut into
    ``pieces`` value ranges of similar size by an approximate sketch (as many as
    the session has shuffle partitions, if not given); sums run inside each range
    and are shifted by the sums of the ranges before it, so the result is exact and
    the largest sort is about one piece. Without ``keys`` the ranges and
    their sums are short lists that rows look into.
    """
    pieces = pieces or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not keys:
        return _running_totals_of_all(df, value, weight, order, pieces)
    cuts = df.groupBy(*keys).agg(
        F.array_distinct(
            F.percentile_approx(
                value, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(10 * pieces)
            )
        ).alias("_cuts")
    )
    placed = (
        df.withColumn("_w", weight)
        .alias("l")
        .join(cuts.alias("r"), _null_safe(keys), "inner")
        .select("l.*", F.size(F.filter("r._cuts", lambda c: c < F.col(f"l.{value}"))).alias("_b"))
    )
    across = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_b")
        .agg(F.sum("_w").alias("_n"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"),
            F.sum("_n").over(W.partitionBy(*keys)).alias("_total"),
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy(value, *order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.alias("l")
        .join(offsets.alias("r"), _null_safe(keys, [F.col("l._b") == F.col("r._b")]), "inner")
        .select("l.*", "r._before", "r._total")
        .withColumn("_end", F.col("_before") + F.sum("_w").over(inside))
        .drop("_before", "_b")
    )


def _running_totals_of_all(df: DataFrame, value: str, weight: Column, order: list[str], pieces: int) -> DataFrame:
    at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = df.agg(F.array_distinct(F.percentile_approx(value, at, F.lit(10 * pieces)))).scalar()
    placed = df.withColumn("_w", weight).withColumn("_cuts", cuts)
    placed = placed.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    one_row_per_piece = W.partitionBy(F.lit(1))
    sizes = placed.groupBy("_b").agg(F.sum("_w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(one_row_per_piece.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_b", before.alias("_before"), F.sum("_n").over(one_row_per_piece).alias("_total"))
    shifts = lookup(sizes, "_b", F.struct("_before", "_total"))
    inside = W.partitionBy("_b").orderBy(value, *order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.withColumn("_shift", F.try_element_at(shifts, F.col("_b")))
        .withColumn("_end", F.col("_shift._before") + F.sum("_w").over(inside))
        .withColumn("_total", F.col("_shift._total"))
        .drop("_shift", "_b")
    )


def exact_quantiles(
    df: DataFrame,
    group_cols: list[str],
    value: str,
    probs: list[float],
    names: list[str],
    count: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    A built-in exact percentile holds all distinct values of a group in one
    task; here values are counted first and ranked piecewise. ``count``
    names a column of counts where the values are counted already.
    """
    keys = group_cols
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(count) if count else F.count(F.lit(1))).alias("_c"))
    )
    ranked = running_totals(counts, keys, "_v", F.col("_c"), [])
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        hit = lambda r: (F.col("_end") - F.col("_c") <= r) & (F.col("_end") > r)
        v_lo, v_hi = F.max(F.when(hit(lo), F.col("_v"))), F.max(F.when(hit(hi), F.col("_v")))
        frac = F.max(h - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def dense_index(df: DataFrame, group_cols: list[str], order_col: str, name: str) -> DataFrame:
    """Number the rows of each group 0..n-1 without sorting a group in one task.

    Rows are spread over 256 slots by hash; each slot is numbered on its own
    and shifted by the size of the slots before it. Also adds ``<name>_n``,
    the group's size. ``order_col`` must be unique within a group.
    """
    slotted = df.withColumn("_slot", F.substring(F.md5(F.col(order_col).cast("string")), 1, 2))
    sizes = slotted.groupBy(*group_cols, "_slot").agg(F.count(F.lit(1)).alias("_m"))
    before = W.partitionBy(*group_cols).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *group_cols,
        "_slot",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_shift"),
        F.sum("_m").over(W.partitionBy(*group_cols)).alias(f"{name}_n"),
    )
    local = F.row_number().over(W.partitionBy(*group_cols, "_slot").orderBy(order_col)) - 1
    return (
        slotted.withColumn("_local", local)
        .join(shifts, [*group_cols, "_slot"])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_slot", "_local", "_shift")
    )


def weighted_median(df: DataFrame, group_cols: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Value where the cumulative weight passes half of the total.

    With an even whole total the mean of that value and the last one at or
    below half. Rows without value or weight, or with weight 0, are left out.
    """
    blocks = (
        df.filter(F.col(value).isNotNull() & (F.col(weight) != 0))
        .groupBy(*group_cols, F.col(value).alias("_v"), F.col(weight).alias("_u"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    r = running_totals(blocks, group_cols, "_v", F.col("_c") * F.col("_u"), ["_u"])
    half = F.col("_total") / 2
    start = F.col("_end") - F.col("_w")
    first = F.min(F.when(F.col("_end") > half, F.col("_v")))
    last = F.max(F.when(start + F.col("_u") <= half, F.col("_v")))
    even = F.max(F.col("_total") % 2) == 0
    return r.groupBy(*group_cols).agg(
        F.when(even, (first + F.coalesce(last, first)) / 2).otherwise(first).alias(name)
    )


# -- means of positive quantities -------------------------------------------------

# Fixed value: floor below which harmonic means do not look.
HARMONIC_FLOOR = 0.00001


def harmonic_mean(x: Column) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (x != float("inf"))
    usable = F.when(finite, F.greatest(x, F.lit(HARMONIC_FLOOR)))
    return F.lit(1.0) / F.avg(F.lit(1.0) / usable)


def harmonic_mean_sd(x: Column) -> Column:
    inv = F.lit(1.0) / x
    return F.sqrt(F.pow(F.avg(inv), F.lit(-4.0)) * F.var_samp(inv) / F.count(F.lit(1)))


def geometric_mean(x: Column) -> Column:
    """exp of the summed logs of positive values over the number of rows."""
    return F.exp(F.sum(F.when(x > 0, F.log(x))) / F.count(F.lit(1)))


def geometric_sd(x: Column) -> Column:
    return F.exp(F.stddev_samp(F.when(x > 0, F.log(x))))


def weighted_mean_variance(df: DataFrame, group_cols: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Variance of a weighted mean (Cochran's ratio form).

    All sums are of products of value and weight, so one aggregation does.
    """
    x, w = F.col(value), F.col(weight)
    p = df.filter(x.isNotNull() & w.isNotNull()).groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(w).alias("sw"),
        F.sum(w * x).alias("swx"),
        F.sum(w * w).alias("sww"),
        F.sum(w * w * x).alias("swwx"),
        F.sum(w * w * x * x).alias("swwxx"),
    )
    n, wbar = F.col("n"), F.col("sw") / F.col("n")
    mean = F.col("swx") / F.col("sw")
    # Expanded sums of squares and products around wbar and wbar * mean.
    a = F.col("swwxx") - 2 * wbar * mean * F.col("swx") + n * F.pow(wbar * mean, F.lit(2))
    b = F.col("swwx") - wbar * mean * F.col("sw") - wbar * F.col("swx") + n * wbar * wbar * mean
    c = F.col("sww") - 2 * wbar * F.col("sw") + n * wbar * wbar
    factor = F.try_divide(n, (n - 1) * F.pow(F.col("sw"), F.lit(2)))
    return p.select(*group_cols, (factor * (a - 2 * mean * b + mean * mean * c)).alias(name))
